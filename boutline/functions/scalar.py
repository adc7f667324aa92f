"""Row-level expressions. Every function takes and returns ``Column`` so the work stays in whole-stage codegen."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rating base, odds scale and method weights the results must agree with.
BASE_RATING = 1500.0
RATING_SCALE = 400.0
DRAW_K_FACTOR = 0.5
DECAY_FLOOR = 0.5
METHOD_WEIGHTS = {"ko": 1.4, "sub": 1.3, "udec": 1.0, "mdec": 0.9, "sdec": 0.7}

# Flag columns that prove each method (own side, other side).
METHOD_FLAGS = {
    "ko": ("ko", "kod"),
    "sub": ("subw", "subwd"),
    "udec": ("udec", "udecd"),
    "mdec": ("mdec", "mdecd"),
    "sdec": ("sdec", "sdecd"),
}
MULTIPLIER_ORDER = ("ko", "sub", "udec", "mdec", "sdec")
LABEL_ORDER = ("ko", "sub", "udec", "sdec", "mdec")
METHOD_LABELS = {
    "ko": "KO/TKO",
    "sub": "Submission",
    "udec": "Unanimous Decision",
    "sdec": "Split Decision",
    "mdec": "Majority Decision",
}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(x) -> Column:
    """A Python number as a double literal; a column unchanged."""
    return x if isinstance(x, Column) else F.lit(float(x))


def first_match(pairs, default=None) -> Column:
    """``when`` chain over (condition, value) pairs."""
    out = None
    for cond, value in pairs:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(F.lit(default) if not isinstance(default, Column) else default)


def text_flag(c) -> Column:
    """Truth of a text cell: ``1``, ``true`` in any case, or a number equal to one; anything else is false."""
    trimmed = F.trim(col(c))
    # lower-casing costs more than all else here, so the usual spellings come first
    true = trimmed.isin("1", "true", "True", "TRUE") | ((F.length(trimmed) == 4) & (F.lower(trimmed) == "true"))
    return F.coalesce(true | F.coalesce(trimmed.try_cast("double") == 1.0, F.lit(False)), F.lit(False))


def epoch_micros(c) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    t = col(c)
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date"))
    clock = F.hour(t) * 3600 + F.minute(t) * 60
    return (days.cast("double") * 86400.0 + clock) * 1e6 + F.extract(F.lit("SECOND"), t).cast("double") * 1e6


def number_flag(c) -> Column:
    return F.coalesce(col(c) == 1, F.lit(False))


def method_hit(method: str) -> Column:
    own, other = METHOD_FLAGS[method]
    return text_flag(own) | text_flag(other)


def method_multiplier(weights=None) -> Column:
    """First proven method decides; ``weights`` maps method to a number or a column of a candidate table."""
    weights = weights or METHOD_WEIGHTS
    return first_match([(method_hit(m), num(weights[m])) for m in MULTIPLIER_ORDER], 1.0)


def method_code() -> Column:
    """Method as a short code, in the multiplier's precedence; null when no flag is set."""
    return first_match([(method_hit(m), F.lit(m)) for m in MULTIPLIER_ORDER])


def multiplier_of_code(code, weights) -> Column:
    return first_match([(col(code) == m, num(weights[m])) for m in MULTIPLIER_ORDER], 1.0)


def method_label(fallback: str = "Unknown") -> Column:
    """Readable method. Here a split decision is tested before a majority one, unlike the multiplier."""
    return first_match([(method_hit(m), F.lit(METHOD_LABELS[m])) for m in LABEL_ORDER], fallback)


def method_label_by_ones(fallback: str = "Unknown") -> Column:
    """Readable method where only a cell equal to one counts as a flag."""
    pairs = [((F.trim(c) == "1"), F.lit(METHOD_LABELS[m])) for m in LABEL_ORDER for c in METHOD_FLAGS[m]]
    return first_match(pairs, fallback)


def expected_score(own, other, scale=RATING_SCALE) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (col(other) - col(own)) / num(scale)))


def decimal_odds(american) -> Column:
    """American to decimal price; a price of zero has no meaning and gives null."""
    a = col(american)
    return F.when(a > 0, a / 100.0 + 1.0).when(a < 0, F.lit(100.0) / F.abs(a) + 1.0)


def implied_probability(american, missing: float | None = 0.5) -> Column:
    a = col(american)
    p = F.when(a > 0, F.lit(100.0) / (a + 100.0)).when(a < 0, F.abs(a) / (F.abs(a) + 100.0))
    return p if missing is None else F.coalesce(p, F.lit(missing))


def kelly_fraction(prob, decimal) -> Column:
    p, d = col(prob), col(decimal)
    b = d - 1.0
    return F.when(d > 1.0, F.try_divide(b * p - (F.lit(1.0) - p), b))


def linear_decay_factor(days, rate, min_days) -> Column:
    d = col(days)
    idle = d - num(min_days)
    return F.when(d.isNull() | (idle < 0), 1.0).otherwise(F.greatest(F.lit(DECAY_FLOOR), F.lit(1.0) - num(rate) * idle))


def exponential_decay_factor(days, rate, min_days) -> Column:
    d = col(days)
    idle = d - num(min_days)
    return F.when(d.isNull() | (idle < 0), 1.0).otherwise(F.greatest(F.lit(DECAY_FLOOR), F.exp(-num(rate) * idle)))


def decay_factor(mode, days, rate, min_days) -> Column:
    """Factor for a mode column or text; unknown modes leave the rating alone."""
    m = mode if isinstance(mode, Column) else F.lit(mode)
    return (
        F.when(m == "linear", linear_decay_factor(days, rate, min_days))
        .when(m == "exponential", exponential_decay_factor(days, rate, min_days))
        .otherwise(1.0)
    )


def multiphase_factor(days, quick_days, bump, decay_days, rate) -> Column:
    """A quick return lifts the rating, a long absence shrinks it, anything between leaves it."""
    d = col(days)
    idle = d - num(decay_days)
    return (
        F.when(d.isNull(), 1.0)
        .when(d < num(quick_days), num(bump))
        .when(idle > 0, F.greatest(F.lit(DECAY_FLOOR), F.exp(-num(rate) * idle)))
        .otherwise(1.0)
    )


def fold_name(name) -> Column:
    """Name without accents, lower case, single blanks; null becomes the empty text. Letters of all Latin blocks and their
    compatibility forms are folded by their Unicode decompositions."""
    one, several = _folds()
    lowered = F.lower(F.coalesce(col(name), F.lit("")))
    plain = F.translate(lowered, "".join(one), "".join(one.values()))
    for letter, text in several.items():
        plain = F.replace(plain, F.lit(letter), F.lit(text))
    bare = F.regexp_replace(plain, r"\p{M}+", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


@lru_cache(maxsize=1)
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """(letters that fold to one letter, letters that fold to several), over the Latin blocks and presentation forms."""
    one, several = {}, {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]:
        letter = chr(code).lower()
        if len(letter) > 1:
            continue
        text = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c)).lower()
        if text and text != letter:
            (one if len(text) == 1 else several)[letter] = text
    return one, several


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def log_loss_term(p, y, eps: float) -> Column:
    q = clamp(col(p), eps, 1.0 - eps)
    y = col(y)
    return -(y * F.ln(q) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - q))


def brier_term(p, y) -> Column:
    return F.pow(col(p) - col(y), F.lit(2.0))


def r6(c, digits: int = 6) -> Column:
    """Round for reporting; adding zero turns a negative zero into zero."""
    return F.round(col(c), digits) + F.lit(0.0)
