"""Forward returns, from the next open to a later one. Not ranked; a code's last rows, which cannot be known yet, go."""

from marlstone.factors.registry import factor
from marlstone.functions.signal import col, lag

HORIZONS = (1, 5, 10, 20)
for days in HORIZONS:
    factor(f"label_ret_{days}d", "target", "daily_adj", lag(col("open"), -1 - days) / lag(col("open"), -1) - 1, ranked=False, trim=1 + days, description=f"open in {days + 1} rows over the next open")
