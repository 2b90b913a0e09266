"""List functions with 1-based indexes, null rules and names of the reference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def list_extract(l, i: int) -> Column:  # noqa: E741
    """1-based, negative from the end, null out of range and for 0."""
    return F.lit(None) if i == 0 else F.try_element_at(_c(l), F.lit(i))


def list_slice(l, begin: int, end: int, step: int = 1) -> Column:  # noqa: E741
    """Inclusive, 1-based, negative from the end, every step-th."""
    x = _c(l)
    n = F.size(x)
    place = lambda i: F.lit(i) if i >= 0 else n + i + 1
    a, b = F.greatest(place(begin), F.lit(1)), F.least(place(end), n)
    cut = F.slice(x, a, F.greatest(b - a + 1, F.lit(0)))
    return cut if step == 1 else F.filter(cut, lambda _, i: i % step == 0)


def list_contains(l, e) -> Column:  # noqa: E741
    """Null only for a null list or needle."""
    return F.when(_c(l).isNotNull() & _c(e).isNotNull(), F.coalesce(F.array_contains(_c(l), _c(e)), F.lit(False)))


def list_position(l, e) -> Column:  # noqa: E741
    """1-based, null where absent."""
    return F.nullif(F.array_position(_c(l), e), F.lit(0))


def list_concat(a, b) -> Column:
    """A null list counts as empty."""
    return F.when(_c(a).isNull(), _c(b)).when(_c(b).isNull(), _c(a)).otherwise(F.concat(_c(a), _c(b)))


def list_distinct(l) -> Column:  # noqa: E741
    """Without nulls."""
    return F.array_distinct(F.array_compact(_c(l)))


def list_unique(l) -> Column:  # noqa: E741
    return F.size(list_distinct(l)).cast("long")


def list_sort(l, descending: bool = False, nulls_first: bool = False) -> Column:  # noqa: E741
    x = _c(l)
    values = F.sort_array(F.array_compact(x), asc=not descending)
    nulls = F.filter(x, lambda v: v.isNull())
    return F.concat(nulls, values) if nulls_first else F.concat(values, nulls)


def list_grade_up(l) -> Column:  # noqa: E741
    """1-based places of the elements in ascending order."""
    pairs = F.transform(_c(l), lambda v, i: F.struct(v.alias("v"), (i + 1).cast("long").alias("i")))
    return F.transform(F.array_sort(pairs), lambda s: s["i"])


def list_transform(l, f: Callable[..., Column]) -> Column:  # noqa: E741
    """f(x) or f(x, i) with a 1-based i."""
    return F.transform(_c(l), f) if f.__code__.co_argcount == 1 else F.transform(_c(l), lambda x, i: f(x, i + 1))


def list_filter(l, f: Callable[..., Column]) -> Column:  # noqa: E741
    return F.filter(_c(l), f) if f.__code__.co_argcount == 1 else F.filter(_c(l), lambda x, i: f(x, i + 1))


def list_reduce(l, f: Callable[[Column, Column], Column]) -> Column:  # noqa: E741
    """Folds from the first element; an empty list raises no error but gives null."""
    x = _c(l)
    return F.when(F.size(x) > 0, F.aggregate(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), F.get(x, F.lit(0)), f))


def list_has_any(a, b) -> Column:
    return F.coalesce(F.arrays_overlap(F.array_compact(_c(a)), F.array_compact(_c(b))), F.lit(False))


def list_has_all(a, b) -> Column:
    """Whether a holds all elements of b."""
    return F.size(F.array_except(F.array_compact(_c(b)), _c(a))) == 0


def list_select(l, indexes) -> Column:  # noqa: E741
    return F.transform(_c(indexes), lambda i: F.try_element_at(_c(l), i.cast("int")))


def list_where(l, mask) -> Column:  # noqa: E741
    return F.filter(_c(l), lambda _, i: F.get(_c(mask), i))


def list_zip(*lists) -> Column:
    """Structs (_1, _2, ...) of the elements at one place; shorter lists are filled up with nulls."""
    return F.arrays_zip(*[_c(l).alias(f"_{i}") for i, l in enumerate(lists, 1)])


def list_resize(l, n: int, fill=None) -> Column:  # noqa: E741
    x = _c(l)
    kind_fill = F.lit(fill)
    return F.slice(F.concat(x, F.array_repeat(kind_fill, n)), 1, n)


def list_sum(l) -> Column:  # noqa: E741
    return F.aggregate(F.array_compact(_c(l)), F.lit(0).cast("double"), lambda s, v: s + v.cast("double"))


def list_avg(l) -> Column:  # noqa: E741
    return F.try_divide(list_sum(l), F.size(F.array_compact(_c(l))))


def list_count(l) -> Column:  # noqa: E741
    return F.size(F.array_compact(_c(l))).cast("long")


def list_median(l) -> Column:  # noqa: E741
    s = F.sort_array(F.array_compact(_c(l)))
    n = F.size(s)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return (low.cast("double") + high.cast("double")) / 2


def list_product(l) -> Column:  # noqa: E741
    return F.aggregate(F.array_compact(_c(l)), F.lit(1.0), lambda s, v: s * v.cast("double"))


def list_var_pop(l) -> Column:  # noqa: E741
    x = F.array_compact(_c(l))
    return F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v - list_avg(l), F.lit(2))), F.size(x))


def flatten(l) -> Column:  # noqa: E741
    """Null sublists are skipped."""
    return F.flatten(F.array_compact(_c(l)))


def range_list(a, b, step: int = 1) -> Column:
    """range(a, b): the end is left out."""
    x, y = (v if isinstance(v, Column) else F.lit(v) for v in (a, b))
    last = y - (1 if step > 0 else -1)
    return F.when(x <= last if step > 0 else x >= last, F.sequence(x, last, F.lit(step))).otherwise(F.array().cast("array<int>"))
