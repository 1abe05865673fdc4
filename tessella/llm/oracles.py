"""SQL of the corpus queries that SQL can express, for DuckDB over whole tables."""

LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = rf"regexp_extract_all(coalesce({LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BLANK_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
  with d as (select doc_id, {ALNUM_WORDS} as w from documents),
  items as (select coalesce(item_id::varchar, 'null') as id, {ALNUM_WORDS} as w from benchmark),
  starts as (select id, w, least(13, len(w)) as size, unnest(range(1, len(w) - least(13, len(w)) + 2)) as k
             from items where len(w) > 0),
  windows as (select distinct id, size, list_slice(w, k, k + size - 1) as gram from starts),
  places as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from d, (select distinct size from windows)),
  found as (select doc_id, id, k, p.size from places p
            join windows q on p.size = q.size and list_slice(w, k, k + p.size - 1) = gram),
  hits as (select doc_id, count(distinct place) as n_hit
           from (select doc_id, unnest(range(k, k + size)) as place from found) group by doc_id),
  named as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
            from (select distinct doc_id, id from found) group by doc_id)
  select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
         sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
  from d left join hits using (doc_id) left join named using (doc_id)"""

NGRAM_JOIN = f"""
  with recursive d as (select doc_id, {BLANK_WORDS.format(LOWERED)} as w from documents),
  shingles as (
    select distinct doc_id, gram from (
      select doc_id, list_slice(w, k, k + 2) as gram from (select doc_id, w, unnest(range(1, len(w) - 1)) as k from d where len(w) >= 3)
      union all select doc_id, w from d where len(w) in (1, 2))),
  sizes as (select doc_id, count(*) as n from shingles group by doc_id),
  shared as (select a.doc_id as x, b.doc_id as y, count(*) as overlap
             from shingles a join shingles b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2),
  links as (select x, y from shared join sizes p on x = p.doc_id join sizes q on y = q.doc_id
            where 100 * overlap >= 90 * (p.n + q.n - overlap)),
  reached(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from reached r join links l on r.y = l.x)
  select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
  from (select x as doc_id, min(y) as component_id from reached group by x) left join sizes using (doc_id)"""

#: Rules as in ``quality.rules``.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 12 * n_words",
}


def _rates() -> str:
    """One row for each host and rule: its failures and documents, and the rule's prior over all hosts."""
    failures = " union all ".join(
        f"select source, '{name}' as rule, count(*)::double as n, count(case when {sql} then 1 end)::double as f from counted group by source"
        for name, sql in RULES.items()
    )
    return f"""
      failures as ({failures}),
      moments as (select rule, sum(f) / sum(n) as m, var_samp(f / n) - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * avg(1 / n) as spread
                  from failures group by rule),
      priors as (select rule, m, greatest(1, least(1000, case when spread > 0 then m * (1 - m) / spread - 1 else 1000 end)) as weight
                 from moments),
      hosts as (select source, max((f + m * weight) / (n + weight)) > 0.5 as failed from failures join priors using (rule) group by source)"""


HOST_QUALITY = f"""
  with d as (select doc_id, source, coalesce(text, '') as text, {BLANK_WORDS.format('text')} as w from documents),
  grams as (select doc_id, k, list_slice(w, k, k + 2) as gram
            from (select doc_id, w, unnest(range(1, len(w) - 1)) as k from d where len(w) >= 3)),
  often as (select doc_id, gram from grams group by doc_id, gram having count(*) > 1),
  again as (select doc_id, count(distinct place) as n
            from (select doc_id, unnest(range(k, k + 3)) as place from grams join often using (doc_id, gram)) group by doc_id),
  lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as dup
            from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
            where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
  counted as (
    select doc_id, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
           coalesce(n_lines, 0) as n_lines, coalesce(dup, 0)::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
    from d left join lines using (doc_id) left join again using (doc_id)),
  {_rates()}
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         ({RULES['short']} or {RULES['repetitive']}) as base_failed,
         not ({RULES['short']} or {RULES['repetitive']}) and not failed as kept
  from counted left join hosts on counted.source is not distinct from hosts.source"""

URL_VERDICTS = r"""
  with parts as (
    select page_id,
           translate(case when url like '%://%' then regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) else '' end,
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           case when url like '%://%' then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path
    from pages),
  rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
  fits as (
    select page_id, host, path, h || p as rule, v,
           row_number() over (partition by page_id order by length(h || p) desc) as n
    from parts left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
  select page_id, host, path, rule, coalesce(v, 'allow') as verdict from fits where n = 1"""

#: crc32 of the bytes (bigint) of a list, with a table made by its rule.
CRC_TABLE = """crc_table as (
    select list(code order by n) as crc from (
      select n, list_reduce(list_concat([n], list_transform(range(8), lambda x: 0)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) as code
      from range(256) r(n)))"""
CRC = """xor(list_reduce(list_concat([4294967295], {0}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"""

PERIODIC_RUNS = f"""
  with {CRC_TABLE},
  split as (select doc_id, {BLANK_WORDS.format('text')} as given, doc_id::varchar as id from documents),
  coded as (select doc_id, given, {CRC.format("list_transform(range(1, length(id) + 1), lambda k: ascii(id[k])::bigint)")} as h
            from split, crc_table),
  tails as (select doc_id, given, h, h // 10 % len(given) as a, 1 + (len(given) - h // 10 % len(given)) // (3 + h // 10 % 8) as p
            from coded),
  d as (select doc_id, case when h % 10 = 0 and len(given) > 0 then
               list_transform(range(len(given)), lambda i: given[case when i < a then i else a + (i - a) % p end + 1])
               else given end as w from tails),
  grams as (select doc_id, k, list_slice(w, k, k + 5) as gram
            from (select doc_id, w, unnest(range(1, len(w) - 4)) as k from d where len(w) >= 12)),
  often as (select doc_id, gram from grams group by doc_id, gram having count(*) > 1),
  places as (select * from grams join often using (doc_id, gram)),
  pairs as (select x.doc_id, x.k, y.k - x.k as q from places x join places y on x.doc_id = y.doc_id and x.gram = y.gram and x.k < y.k),
  islands as (select *, k - row_number() over (partition by doc_id, q order by k) as island from pairs),
  squares as (select doc_id, min(k) - 1 as start, count(*) + 5 + q as length, q from islands group by doc_id, q, island
              having count(*) + 5 >= q),
  runs as (select doc_id, start, length, min(q) as period from squares where length >= 12 group by doc_id, start, length),
  listed as (select doc_id, count(*) as n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as runs,
                    min({{'l': -length, 's': start, 'p': period}}) as best from runs group by doc_id),
  dropped as (select distinct doc_id, unnest(range(start + period + 1, start + length + 1)) as k from runs),
  words as (select doc_id, unnest(range(1, len(w) + 1)) as k, unnest(w) as word from d),
  kept as (select doc_id, string_agg(word, ' ' order by k) as text from words anti join dropped using (doc_id, k) group by doc_id)
  select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, (-best.l)::bigint as length, best.p::bigint as period,
         (1000 * -best.l // best.p)::bigint as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(text, '')) as collapsed_sha256
  from d left join listed using (doc_id) left join kept using (doc_id)"""

ORACLES = {
    "op2_decontamination": DECONTAMINATION,
    "op4_ngram_join": NGRAM_JOIN,
    "op9_host_quality": HOST_QUALITY,
    "op10_url_rules": URL_VERDICTS,
    "op11_periodic_runs": PERIODIC_RUNS,
}
