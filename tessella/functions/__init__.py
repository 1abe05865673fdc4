"""Column functions and driver-side naming rules."""
