"""String functions whose semantics differ from Spark's built-ins, or that Spark lacks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def concat(*parts: str | Column) -> Column:
    """concat(...): nulls are skipped (the operator || is F.concat)."""
    return F.concat(*[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])


def left(s: str | Column, n: int) -> Column:
    """The first n characters; a negative n leaves out the last -n."""
    s = _c(s)
    return F.left(s, F.lit(n)) if n >= 0 else F.substring(s, F.lit(1), F.greatest(F.char_length(s) + n, F.lit(0)))


def right(s: str | Column, n: int) -> Column:
    """The last n characters; a negative n leaves out the first -n."""
    s = _c(s)
    return F.right(s, F.lit(n)) if n >= 0 else F.substring(s, F.lit(1 - n), F.greatest(F.char_length(s) + n, F.lit(0)))


def string_split(s: str | Column, separator: str) -> Column:
    """Split at a literal separator; an empty one gives the characters."""
    return F.filter(F.split(_c(s), ""), lambda x: x != "") if separator == "" else F.split(_c(s), re.escape(separator), -1)


def split_part(s: str | Column, separator: str, index: int) -> Column:
    """The index-th part, 1-based, negative from the end, '' out of range."""
    return F.coalesce(F.get(string_split(s, separator), F.lit(index - 1)) if index > 0 else F.try_element_at(string_split(s, separator), F.lit(index)), F.lit(""))


def regexp_full_match(s: str | Column, pattern: str) -> Column:
    return _c(s).rlike(f"^(?:{pattern})$")


def regexp_replace(s: str | Column, pattern: str, replacement: str, options: str = "") -> Column:
    """Replaces the first match, with option g all; options i (case) and l (literal) as well."""
    flags = "(?i)" if "i" in options else ""
    body = re.escape(pattern) if "l" in options else pattern
    java = replacement.replace("$", "\\$") if "l" in options else re.sub(r"\\(\d)", r"$\1", replacement)
    if "g" in options:
        return F.regexp_replace(_c(s), flags + body, java)
    groups = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", java)
    return F.regexp_replace(_c(s), f"(?s)^(.*?){flags}(?:{body})".replace("(.*?)", "((?:.|\\n)*?)"), "$1" + groups)


def glob(s: str | Column, pattern: str) -> Column:
    """s GLOB pattern: *, ?, [abc], [!a-z]."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return _c(s).rlike(f"(?s)^{out}$")


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Jaccard similarity of the two sets of characters."""
    x, y = (F.array_distinct(F.filter(F.split(_c(v), ""), lambda c: c != "")) for v in (a, b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def hamming(a: str | Column, b: str | Column) -> Column:
    """Number of places that differ; strings of unlike length raise."""
    x, y = F.split(_c(a), ""), F.split(_c(b), "")
    count = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 0).otherwise(1)), F.lit(0), lambda s, v: s + v)
    return F.when(F.char_length(_c(a)) == F.char_length(_c(b)), count.cast("long")).otherwise(F.raise_error(F.lit("strings of unlike length")).cast("long"))


def format_bytes(n: str | Column, base: int = 1024) -> Column:
    """Bytes as text with one decimal, in binary (or base 1000: decimal) units."""
    value = _c(n).cast("double")
    units = ["KiB", "MiB", "GiB", "TiB", "PiB"] if base == 1024 else ["kB", "MB", "GB", "TB", "PB"]
    out = F.when(value == 1, F.lit("1 byte")).when(F.abs(value) < base, F.concat(_c(n).cast("string"), F.lit(" bytes")))
    for power, unit in enumerate(units, 1):
        scaled = F.floor(F.floor(value / base ** (power - 1)) * 10 / base) / 10
        text = F.concat(F.format_string("%.1f", scaled), F.lit(f" {unit}"))
        out = out.when(F.abs(value) < base ** (power + 1), text) if power < len(units) else out.otherwise(text)
    return out


def bar(x: str | Column, low: float, high: float, width: int = 80) -> Column:
    """A bar of block characters, in eighths."""
    share = (F.least(F.greatest(_c(x).cast("double"), F.lit(low)), F.lit(high)) - low) / (high - low)
    eighths = F.floor(share * width * 8).cast("int")
    full = F.floor(eighths / 8).cast("int")
    #: The block characters from one eighth to seven.
    part = F.element_at(F.array(*[F.lit(c) for c in ["", "▏", "▎", "▍", "▌", "▋", "▊", "▉"]]), (eighths % 8 + 1).cast("int"))
    return F.rpad(F.concat(F.repeat(F.lit("█"), full), part), width, " ")


def url_encode(s: str | Column) -> Column:
    """Percent encoding, spaces as %20."""
    return F.replace(F.replace(F.replace(F.url_encode(_c(s)), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def parse_filename(path: str | Column, trim_extension: bool = False) -> Column:
    name = F.substring_index(_c(path), "/", -1)
    return F.regexp_replace(name, r"\.[^.]*$", "") if trim_extension else name


def parse_dirname(path: str | Column) -> Column:
    """The first directory."""
    return F.when(F.instr(_c(path), "/") > 0, F.substring_index(_c(path), "/", 1)).otherwise(F.lit(""))


def parse_dirpath(path: str | Column) -> Column:
    """All directories."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def parse_path(path: str | Column) -> Column:
    return F.filter(F.split(_c(path), "/"), lambda x: x != "")


def to_base(n: str | Column, base: int, width: int = 0) -> Column:
    text = F.upper(F.conv(_c(n).cast("string"), 10, base))
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def format_braces(pattern: str, *values: str | Column) -> Column:
    """format('{} and {}', ...)."""
    return F.format_string(pattern.replace("%", "%%").replace("{}", "%s"), *[_c(v).cast("string") for v in values])


def _each(f: Callable[[str], object], kind: pa.DataType, texts: pa.Array) -> pa.Array:
    """f of each text, one in Python at a time; null for null."""
    return pa.array((None if not x.is_valid else f(x.as_py()) for x in texts), kind, size=len(texts))


def _plain(x: str) -> str:
    return x if x.isascii() else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


def _graphemes(x: str) -> int:
    import regex

    return len(x) - x.count("\r\n") if x.isascii() else sum(1 for _ in regex.finditer(r"\X", x))


@F.arrow_udf(T.StringType())
def strip_accents(s: pa.Array) -> pa.Array:
    return _each(_plain, pa.string(), s)


@F.arrow_udf(T.StringType())
def nfc_normalize(s: pa.Array) -> pa.Array:
    return _each(lambda x: unicodedata.normalize("NFC", x), pa.string(), s)


@F.arrow_udf(T.LongType())
def length_grapheme(s: pa.Array) -> pa.Array:
    return _each(_graphemes, pa.int64(), s)


def _damerau(a: str, b: str) -> int:
    """Restricted to adjacent transpositions counted once, unrestricted in what follows them."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = {(-1, j): far for j in range(-1, len(b) + 1)} | {(i, -1): far for i in range(len(a) + 1)}
    for i in range(len(a) + 1):
        d[i, 0] = i
    for j in range(len(b) + 1):
        d[0, j] = j
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            if x == y:
                seen = j
            d[i, j] = min(d[i - 1, j - 1] + (x != y), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[len(a), len(b)]


#: Pairs of up to SHORT characters a side are computed side by side, in blocks of CELLS cells of their tables.
SHORT, CELLS = 128, 1 << 20


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points in rows padded by -1, lengths) of texts."""
    size = np.array([len(t) for t in texts])
    out = np.full((len(texts), int(size.max())), -1, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out, size


def _damerau_block(left: list[str], right: list[str]) -> np.ndarray:
    """_damerau of many pairs at once, cell by cell."""
    (a, la), (b, lb) = _codes(left), _codes(right)
    n, w, h = len(left), a.shape[1], b.shape[1]
    rows = np.arange(n)
    # Place (i, j) of the table is at [i + 1, j + 1].
    d = np.zeros((w + 2, h + 2, n), np.int32)
    d[0] = d[:, 0] = la + lb
    d[1:, 1] = np.arange(w + 1)[:, None]
    d[1, 1:] = np.arange(h + 1)[:, None]
    last = np.zeros((h, n), np.int32)
    for i in range(1, w + 1):
        x, seen = a[:, i - 1], np.zeros(n, np.int32)
        alike = (b == x[:, None]).T
        for j in range(1, h + 1):
            same, k = alike[j - 1], last[j - 1]
            moved = d[k, seen, rows] + (i - k - 1) + 1 + (j - seen - 1)
            d[i + 1, j + 1] = np.minimum(np.minimum(d[i, j] + ~same, moved), np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
            seen = np.where(same, j, seen).astype(np.int32)
        last[alike] = i
    return d[la + 1, lb + 1, rows]


def _jaro_block(left: list[str], right: list[str]) -> np.ndarray:
    """_jaro of many pairs at once."""
    (a, la), (b, lb) = _codes(left), _codes(right)
    n, w, h = len(left), a.shape[1], b.shape[1]
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    most, place = int(reach.max()), np.arange(h)
    used, first, m = np.zeros((n, h), bool), np.zeros((n, w), np.int32), np.zeros(n, np.int64)
    for i in range(w):
        low, high = max(0, i - most), min(h, i + most + 1)
        if low >= high:
            continue
        free = (b[:, low:high] == a[:, i, None]) & ~used[:, low:high] & (np.abs(place[low:high] - i) <= reach[:, None]) & (i < la)[:, None]
        hit = np.flatnonzero(free.any(axis=1))
        used[hit, low + free[hit].argmax(axis=1)] = True
        first[hit, m[hit]] = a[hit, i]
        m[hit] += 1
    second = np.zeros((n, w), np.int32)
    row, at = np.nonzero(used)
    second[row, (np.cumsum(used, axis=1) - 1)[row, at]] = b[row, at]
    moved = (first != second).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (m / la + m / lb + (m - moved) / m) / 3
    return np.where((la == 0) | (lb == 0), (la == lb).astype(float), np.where(m == 0, 0.0, score))


def _pairs(one: Callable, block: Callable, a: pa.Array, b: pa.Array, kind: pa.DataType) -> pa.Array:
    """one of each pair, by blocks of pairs of like lengths where both sides are short; null for null."""
    x, y = a.to_pylist(), b.to_pylist()
    out: list = [None] * len(x)
    size = [-1 if p is None or q is None else max(len(p), len(q)) for p, q in zip(x, y)]
    order, at = sorted((i for i, s in enumerate(size) if s >= 0), key=size.__getitem__), 0
    while at < len(order):
        # The block's longest pair decides the size of its tables.
        end = at + 1
        while end < len(order) and size[order[end]] <= SHORT and (end + 1 - at) * (size[order[end]] + 2) ** 2 <= CELLS:
            end += 1
        some = order[at:end]
        if size[some[-1]] > SHORT or not size[some[-1]]:
            for i in some:
                out[i] = one(x[i], y[i])
        else:
            for i, v in zip(some, block([x[i] for i in some], [y[i] for i in some]).tolist()):
                out[i] = v
        at = end
    return pa.array(out, kind)


@F.arrow_udf(T.LongType())
def damerau_levenshtein(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairs(_damerau, _damerau_block, a, b, pa.int64())


def _jaro(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, first = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                first.append(x)
                break
    second = [b[j] for j in range(len(b)) if used[j]]
    m = len(first)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(first, second)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


@F.arrow_udf(T.DoubleType())
def jaro_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairs(_jaro, _jaro_block, a, b, pa.float64())


@F.arrow_udf(T.DoubleType())
def jaro_winkler_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    def winkler(x: str, y: str, base: float) -> float:
        same = 0
        for p, q in zip(x[:4], y[:4]):
            if p != q:
                break
            same += 1
        return base + same * 0.1 * (1 - base) if base > 0.7 else base

    base = _pairs(_jaro, _jaro_block, a, b, pa.float64()).to_pylist()
    return pa.array([None if v is None else winkler(x, y, v) for x, y, v in zip(a.to_pylist(), b.to_pylist(), base)], pa.float64())
