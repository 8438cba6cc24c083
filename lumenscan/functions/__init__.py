"""Column functions: guarded comparisons, arrays, text, time and record helpers."""
