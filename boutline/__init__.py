"""Contest ratings, odds, bets and backtests as Spark DataFrame operators."""
