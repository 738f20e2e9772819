"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: The ten buckets of a split, in order: fixed values.
BUCKETS = ("train",) * 8 + ("val", "test")
#: The order in which localised values are preferred: fixed values.
LADDER = ("en_US", "en_GB", "en_IN", "en_CA", "en_AU", "en_AE", "en_SG")


def double(x) -> Column:
    return F.lit(float(x))


def hash_split(key: Column) -> Column:
    """The split of ``key``: its SHA-1 as a number, modulo 10. As 16 to any power ends in 6, digits suffice."""
    digest = F.sha1(key.cast("string").cast("binary"))
    digit = lambda i: F.conv(F.substring(digest, i, 1), 16, 10).cast("int")
    rest = (6 * reduce(lambda a, b: a + b, (digit(i) for i in range(1, 40))) + digit(40)) % 10
    return F.element_at(F.array(*map(F.lit, BUCKETS)), rest + 1)


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))


def title_hash(title: Column) -> Column:
    """63 bits of the SHA-1 of the lower-cased title with its white space collapsed; 0 where there is none."""
    head = F.conv(F.substring(F.sha1(normal_title(title).cast("binary")), 1, 16), 16, -10).cast("long")
    return F.when(title.isNull() | (normal_title(title) == ""), F.lit(0).cast("long")).otherwise(F.shiftrightunsigned(head, 1))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def localized_pick(entries: Column, ladder: tuple[str, ...] = LADDER) -> Column:
    """(value, tag) of the first tag of ``ladder`` for which ``entries`` (tag, value structs) has a value that isn't empty."""
    one = lambda tag: F.get(F.filter(entries, lambda e: (e["language_tag"] == tag) & (e["value"] != "")), F.lit(0))
    found = F.filter(F.array(*(one(t) for t in ladder)), lambda x: x.isNotNull())
    first = F.get(found, F.lit(0))
    return F.struct(first["value"].alias("value"), first["language_tag"].alias("tag"))


def plausible_photo(width: Column, height: Column, most: float = 4.0) -> Column:
    """Neither side over ``most`` times the other; false without a height."""
    return F.coalesce(F.try_divide(width.cast("double"), height.cast("double")).between(1.0 / most, most), F.lit(False))


def plausible_source(width: Column, height: Column) -> Column:
    """Fit to make mutations from: at least 700 a side, and nearly square."""
    ratio = F.try_divide(width.cast("double"), height.cast("double"))
    return F.coalesce((F.least(width, height) >= 700) & ratio.between(0.7, 1.4), F.lit(False))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def normalised_distance(a: Column, b: Column, bits: int = 64) -> Column:
    """``hamming`` as a share of the hash's bits."""
    return hamming(a, b) / double(bits)


def tiles_agreeing(a: Column, b: Column, most: int) -> Column:
    """Cells at a distance of ``most`` or less; lists of other lengths are an error."""
    same = F.size(F.filter(F.zip_with(a, b, hamming), lambda d: d <= most))
    return F.when(F.size(a) == F.size(b), same).otherwise(F.raise_error(F.lit("tile lists differ in length")).cast("int"))


def hex16(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def sample_key(product: Column, occurrence: Column) -> Column:
    return F.format_string("%s-%02d", product.cast("string"), occurrence.cast("int"))


def recall_at(rank: Column, k: int) -> Column:
    return F.when(rank <= k, double(1)).otherwise(double(0))


def reciprocal_rank(rank: Column) -> Column:
    return double(1) / rank


def ndcg_at(rank: Column, k: int = 10) -> Column:
    """One relevant item: the gain at its rank."""
    return F.when(rank <= k, double(1) / F.log2(rank + double(1))).otherwise(double(0))


def claimed(low: Column, high: Column) -> Column:
    """Whether an interval leaves out 0, on either side."""
    return ~((low <= 0) & (high >= 0))


def learning_rate(step: Column, base: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then half a cosine down to 0 at ``total``; flat if there is no more than the warm-up."""
    rising = double(base) * (step + 1) / double(max(warmup, 1))
    if total <= warmup:
        return F.when(step < warmup, rising).otherwise(double(base))
    done = F.least(double(1), (step - warmup) / double(total - warmup))
    return F.when(step < warmup, rising).otherwise(double(base) * double(0.5) * (double(1) + F.cos(F.pi() * done)))


def round4(x: Column) -> Column:
    """Four places; halves go as the binary value lies, to even where it lies between."""
    return F.bround(x, 4)


def colour_name(r: Column, g: Column, b: Column) -> Column:
    """A coarse name: greys by lightness if channels lie within 12, else the tint of the greatest channel."""
    low, high = F.least(r, g, b), F.greatest(r, g, b)
    grey = F.when(low >= 235, "off-white").when(low >= 180, "light grey").when(low >= 90, "grey").otherwise("dark grey or black")
    tint = F.when(r == high, "reddish or warm").when(g == high, "greenish").otherwise("bluish")
    named = F.concat(F.when(low >= 180, "a light ").otherwise("a "), tint, F.lit(" colour"))
    return F.when(high - low <= 12, grey).otherwise(named)
