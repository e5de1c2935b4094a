"""Functions of array columns. Nothing here leaves the row, so nothing shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _size(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def tail(c: Column, n: int) -> Column:
    """The last n elements, or all if there are fewer; a null list stays null."""
    if n <= 0:
        return F.slice(c, 1, 0)
    return F.slice(c, F.greatest(F.size(c) - n, F.lit(0)) + 1, F.lit(n))


def pad_left(c: Column, n: int, value: Column) -> Column:
    """Exactly n elements: the last n, with `value` before them where there are fewer."""
    return F.slice(F.concat(F.array_repeat(value, n), c), -n, n)


def binary_labels(inview: Column, clicked: Column) -> Column:
    """1 for each element that was clicked; a null click list is an empty one."""
    return F.transform(inview, lambda x: F.coalesce(F.array_contains(clicked, x), F.lit(False)).cast("int"))


def clicked_of(inview: Column, labels: Column) -> Column:
    """Elements with label 1, in order."""
    return F.transform(F.filter(F.arrays_zip(inview.alias("i"), labels.alias("l")), lambda z: z["l"] == 1), lambda z: z["i"])


def without(c: Column, other: Column) -> Column:
    """Elements that are not in the other list; order and repeats stay."""
    return F.filter(c, lambda x: ~F.coalesce(F.array_contains(other, x), F.lit(False)))


def keep_listed(c: Column, allowed: Column) -> Column:
    """Elements that are allowed; null when none remain."""
    left = F.filter(c, lambda x: F.coalesce(F.array_contains(allowed, x), F.lit(False)))
    return F.when(F.size(left) > 0, left)


def keep_scalar(c: Column, allowed: list) -> Column:
    """The value where it is allowed, null elsewhere."""
    return F.when(c.isin(allowed), c)


def joined(c: Column, sep: str = " ") -> Column:
    return F.array_join(c, sep)


def concat_columns(*cols: Column, sep: str = " ") -> Column:
    """Columns joined by a separator; null if any is null."""
    parts = [cols[0]]
    for c in cols[1:]:
        parts += [F.lit(sep), c]
    return F.concat(*parts)


def chunks(c: Column, n: int) -> Column:
    """The list cut into lists of n; the last may be shorter."""
    cut = F.transform(F.sequence(F.lit(0), _size(c) - 1, F.lit(n)), lambda i: F.slice(c, i + 1, F.lit(n)))
    return F.when(_size(c) > 0, cut).otherwise(F.slice(F.array(c), 1, 0))


def _weights(c: Column, each) -> Column:  # noqa: ANN001
    """A weight for each place of a list, from place and size; null and empty lists give an empty one."""
    n = F.size(c)
    empty = F.expr("array()").cast("array<double>")
    return F.when(_size(c) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: each(i, n))).otherwise(empty)


def linear_decay(c: Column, ascending: bool = True) -> Column:
    """(i + 1) / n for the i-th element, or the reverse."""
    return _weights(c, lambda i, n: (i + 1) / n if ascending else (n - i) / n)


def exponential_decay(c: Column, rate: float = 0.5, ascending: bool = True) -> Column:
    """rate ** (n - 1 - i) for the i-th element, or the reverse."""
    return _weights(c, lambda i, n: F.pow(F.lit(rate), (n - 1 - i if ascending else i).cast("double")))


def scale_nested(nested: Column, weights: Column) -> Column:
    """Each inner list times its weight; a null inner list becomes one null."""
    times = lambda v, w: F.when(v.isNull(), F.array(F.lit(None).cast("double"))).otherwise(F.transform(v, lambda x: x * w))
    return F.zip_with(nested, weights, times)


def map_values(ids: Column, mapping: Column, fill: Column | None = None, drop_nulls: bool = False) -> Column:
    """Each id replaced by its value in a map column; unknown ids are null, filled or dropped.

    A null list becomes a list of the fill value (or of one null), or stays null when nulls are dropped.
    For maps beyond a few thousand entries, join instead (`operators.labelling.map_list_ids`).
    """
    found = F.transform(ids, lambda x: F.try_element_at(mapping, x))
    if drop_nulls:
        return F.array_compact(found)
    value = fill if fill is not None else F.lit(None)
    return F.coalesce(F.transform(found, lambda v: F.coalesce(v, value)) if fill is not None else found, F.array(value))


def rank_by_score(scores: Column) -> Column:
    """Rank of each element, 1 for the highest; of equal ones the later ranks first."""
    better = lambda s, i: F.size(F.filter(F.transform(scores, lambda t, j: F.struct(t.alias("t"), j.alias("j"))), lambda o: (o["t"] > s) | ((o["t"] == s) & (o["j"] > i))))
    return F.transform(scores, lambda s, i: better(s, i) + 1)


def shuffled(c: Column, seed: Column, key: Column) -> Column:
    """A permutation that depends on seed and key only: elements ordered by a digest of both and their place."""
    tagged = F.transform(c, lambda x, i: F.struct(F.md5(F.concat_ws("|", seed.cast("string"), key.cast("string"), i.cast("string"))).alias("k"), x.alias("v")))
    return F.transform(F.array_sort(tagged), lambda z: z["v"])


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once for a lambda that uses it for each element; inside the lambda it would be taken each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n).otherwise(F.lit(1.0))


def distinct(c: Column) -> Column:
    """Different elements, in order of their first place."""
    return F.array_distinct(c)


def drop_nulls(c: Column) -> Column:
    """Elements that are not null; a null list stays null."""
    return F.array_compact(c)


def append(c: Column, value: Column) -> Column:
    """The list with a value after its last element."""
    return F.concat(c, F.array(value))


def last(c: Column) -> Column:
    """A list of the last element, or an empty one."""
    return tail(c, 1)


def first_element(c: Column) -> Column:
    """The first element, null for an empty list."""
    return F.get(c, F.lit(0))


def zeros_like(c: Column) -> Column:
    """A list of zeros of the same length."""
    return F.transform(c, lambda _: F.lit(0))


def mean(c: Column) -> Column:
    """Mean of the elements that are not null; null where there are none."""
    known = F.array_compact(c)
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(known) > 0, total / F.size(known))


def keys_in(c: Column, mapping: Column) -> Column:
    """Elements that are keys of a map column, in order."""
    return F.filter(c, lambda x: F.map_contains_key(mapping, x))


def run_lengths(c: Column) -> Column:
    """Structs (value, n) of the runs of equal elements of a list without nulls; none for a null list."""
    n = _size(c)
    first = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get(c, i) != F.get(c, i - 1))))
    runs = F.get(F.transform(F.array(first), lambda s: F.transform(s, lambda i, k: F.struct(F.get(c, i).alias("value"), (F.coalesce(F.get(s, k + 1), n) - i).cast("long").alias("n")))), F.lit(0))
    return runs
