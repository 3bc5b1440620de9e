"""Column expressions: text cleaning, intervals and business days, rounding and bucketing."""
