"""String, numeric, bit and vector functions."""

from pyspark.sql import functions as F

from quern.functions import numeric as N, strings as S, vectors as V
from quern.functions.udfs import byte_batches
from quern.plans.registry import frame_query, sql_query
from quern.session import table


def _strings(cols):
    return lambda s, d: table(s, d, "customer").select("c_custkey", *[c.alias(n) for n, c in cols().items()])


_C = "FROM customer"
sql_query("str_case_length", "documents", "SELECT doc_id, upper(lang) AS u, lower(source) AS l, char_length(text) AS n, octet_length(text) AS b, bit_length(lang) AS bits FROM documents",
          "SELECT doc_id, upper(lang) AS u, lower(source) AS l, CAST(length(text) AS INT) AS n, CAST(strlen(text) AS INT) AS b, CAST(bit_length(lang) AS INT) AS bits FROM documents")
sql_query("str_slices", "customer", "SELECT c_custkey, substring(c_name, 3, 4) AS a, substring(c_name, -4) AS b, left(c_name, 5) AS l, right(c_name, 4) AS r, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 5, '*') AS rp FROM customer")
frame_query("str_left_right_negative", _strings(lambda: dict(a=S.left("c_name", -3), b=S.right("c_name", -9))), f"SELECT c_custkey, left(c_name, -3) AS a, right(c_name, -9) AS b {_C}")
frame_query("str_trim_chars", _strings(lambda: dict(a=F.btrim("c_mktsegment", F.lit("BGY")), b=F.ltrim("c_name", F.lit("Cust")), c=F.rtrim("c_name", F.lit("0")))), f"SELECT c_custkey, trim(c_mktsegment, 'BGY') AS a, ltrim(c_name, 'Cust') AS b, rtrim(c_name, '0') AS c {_C}")
sql_query("str_transform", "customer", "SELECT c_custkey, repeat(left(c_name, 2), 3) AS rp, reverse(c_name) AS rv, replace(c_name, '0', 'o') AS re, translate(c_name, 'Cu', 'Kx') AS tr, ascii(c_name) AS a, chr(65 + CAST(c_custkey % 26 AS INT)) AS ch FROM customer")
sql_query("str_search", "customer", "SELECT c_custkey, contains(c_name, '99') AS c, startswith(c_name, 'Cust') AS s, endswith(c_name, '7') AS e, CAST(instr(c_name, '#') AS BIGINT) AS i FROM customer",
          "SELECT c_custkey, contains(c_name, '99') AS c, starts_with(c_name, 'Cust') AS s, suffix(c_name, '7') AS e, instr(c_name, '#') AS i FROM customer")
frame_query("str_concat", _strings(lambda: dict(a=S.concat("c_name", F.lit(None), "c_custkey"), b=F.concat("c_name", F.nullif("c_mktsegment", F.lit("BUILDING"))), c=F.concat_ws("-", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("z")))),
            f"SELECT c_custkey, concat(c_name, NULL, c_custkey) AS a, c_name || nullif(c_mktsegment, 'BUILDING') AS b, concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING'), 'z') AS c {_C}")
frame_query("str_split", _strings(lambda: dict(a=S.string_split("c_name", "#"), b=S.split_part("c_name", "#", 2), c=S.split_part("c_name", "#", 5), d=F.split("c_name", "[0#]+"))),
            f"SELECT c_custkey, string_split(c_name, '#') AS a, split_part(c_name, '#', 2) AS b, split_part(c_name, '#', 5) AS c, string_split_regex(c_name, '[0#]+') AS d {_C}")
frame_query("str_regexp", _strings(lambda: dict(a=F.col("c_name").rlike("9+$"), b=S.regexp_full_match("c_name", r"Cust.*[0-4]"), c=S.regexp_replace("c_name", "0", "-"), d=S.regexp_replace("c_name", "0", "-", "g"), e=F.regexp_extract("c_name", r"([1-9])", 1), f=F.regexp_extract_all("c_name", F.lit(r"[1-9]"), F.lit(0)), g=S.regexp_replace("c_name", "CUSTOMER", "x", "i"))),
            rf"SELECT c_custkey, regexp_matches(c_name, '9+$') AS a, regexp_full_match(c_name, 'Cust.*[0-4]') AS b, regexp_replace(c_name, '0', '-') AS c, regexp_replace(c_name, '0', '-', 'g') AS d, regexp_extract(c_name, '([1-9])', 1) AS e, regexp_extract_all(c_name, '[1-9]') AS f, regexp_replace(c_name, 'CUSTOMER', 'x', 'i') AS g {_C}")
sql_query("str_like", "part", "SELECT p_partkey, p_name LIKE 'red%' AS a, p_name ILIKE '%RING' AS b, p_name LIKE '%r_n%' AS c, 'a%b' LIKE 'a!%b' ESCAPE '!' AS e FROM part")
frame_query("str_glob", lambda s, d: table(s, d, "part").select("p_partkey", S.glob("p_name", "r*[a-g]?*").alias("a"), S.glob("p_name", "[!r]*").alias("b")), "SELECT p_partkey, p_name GLOB 'r*[a-g]?*' AS a, p_name GLOB '[!r]*' AS b FROM part")
frame_query("str_distance", _strings(lambda: dict(a=F.levenshtein("c_name", F.reverse("c_name")).cast("long"), b=S.hamming("c_name", F.reverse("c_name")), c=F.round(S.jaccard("c_name", "c_mktsegment"), 8), d=S.damerau_levenshtein("c_name", F.reverse("c_name")), e=F.round(S.jaro_similarity("c_name", "c_mktsegment"), 8), f=F.round(S.jaro_winkler_similarity("c_name", F.lit("Customer#000000123")), 8))),
            f"SELECT c_custkey, levenshtein(c_name, reverse(c_name)) AS a, hamming(c_name, reverse(c_name)) AS b, round(jaccard(c_name, c_mktsegment), 8) AS c, damerau_levenshtein(c_name, reverse(c_name)) AS d, round(jaro_similarity(c_name, c_mktsegment), 8) AS e, round(jaro_winkler_similarity(c_name, 'Customer#000000123'), 8) AS f {_C}")
sql_query("str_hash", "customer", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha2(c_name, 256) AS s2 FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2 FROM customer")
sql_query("str_codecs", "customer", "SELECT c_custkey, base64(CAST(c_name AS BINARY)) AS b, hex(c_custkey) AS h, hex(CAST(c_name AS BINARY)) AS hs, bin(c_custkey) AS bi, CAST(unbase64(base64(CAST(c_name AS BINARY))) AS STRING) AS back FROM customer",
          "SELECT c_custkey, base64(c_name::BLOB) AS b, hex(c_custkey) AS h, hex(c_name) AS hs, bin(c_custkey) AS bi, c_name AS back FROM customer")
frame_query("str_format", _strings(lambda: dict(a=F.format_string("%05d|%s", "c_custkey", "c_mktsegment"), b=S.format_braces("{} of {}", "c_name", "c_nationkey"), c=S.to_base("c_custkey", 36), d=S.format_bytes(F.col("c_custkey") * 12345))),
            f"SELECT c_custkey, printf('%05d|%s', c_custkey, c_mktsegment) AS a, format('{{}} of {{}}', c_name, c_nationkey) AS b, to_base(c_custkey, 36) AS c, format_bytes(c_custkey * 12345) AS d {_C}")
frame_query("str_bar", _strings(lambda: dict(a=S.bar("c_custkey", 0, 1500, 10))), f"SELECT c_custkey, bar(c_custkey, 0, 1500, 10) AS a {_C}")


def _unicode(s, d):
    byte_batches(s)
    return table(s, d, "documents").select("doc_id", S.strip_accents("text").alias("a"), S.nfc_normalize("text").alias("b"), S.length_grapheme("text").alias("g"))


frame_query("str_unicode", _unicode,
            "SELECT doc_id, strip_accents(text) AS a, nfc_normalize(text) AS b, length_grapheme(text) AS g FROM documents")
frame_query("str_url_path", lambda s, d: table(s, d, "pages").select("page_id", S.url_encode("url").alias("e"), F.url_decode(F.replace(S.url_encode("url"), F.lit("+"), F.lit("%2B"))).alias("d"), S.parse_filename("url").alias("f"), S.parse_dirname("url").alias("dn"), S.parse_dirpath("url").alias("dp"), S.parse_path("url").alias("p")),
            "SELECT page_id, url_encode(url) AS e, url AS d, parse_filename(url) AS f, parse_dirname(url) AS dn, parse_dirpath(url) AS dp, list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages")
frame_query("str_extract_char", _strings(lambda: dict(a=F.substring("c_name", 2, 1))), f"SELECT c_custkey, c_name[2] AS a {_C}")

def _numbers(cols):
    return lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_partkey", *[c.alias(n) for n, c in cols().items()])


_TRIG = ["sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "degrees", "radians"]
_L = "FROM lineitem"
sql_query("num_arithmetic", "lineitem", f"SELECT l_orderkey, l_partkey, l_partkey + l_suppkey AS a, l_partkey - l_suppkey AS s, l_linenumber * 3 AS m, l_partkey div 7 AS d, l_partkey % 7 AS r, -l_quantity AS n {_L}",
          f"SELECT l_orderkey, l_partkey, l_partkey + l_suppkey AS a, l_partkey - l_suppkey AS s, l_linenumber * 3 AS m, l_partkey // 7 AS d, l_partkey % 7 AS r, -l_quantity AS n {_L}")
frame_query("num_division", _numbers(lambda: dict(a=N.fdivide("l_quantity", F.col("l_linenumber") - 3), b=N.idivide("l_partkey", F.col("l_suppkey") % 3), c=N.mod("l_partkey", F.col("l_suppkey") % 3))),
            f"SELECT l_orderkey, l_partkey, l_quantity / (l_linenumber - 3) AS a, l_partkey // nullif(l_suppkey % 3, 0) AS b, l_partkey % nullif(l_suppkey % 3, 0) AS c {_L}")
frame_query("num_rounding", _numbers(lambda: dict(a=F.round("l_extendedprice", 1), b=F.ceil("l_extendedprice").cast("double"), c=F.floor("l_extendedprice").cast("double"), d=N.trunc(-F.col("l_extendedprice")), e=N.to_integer(F.col("l_quantity") / 2), f=N.even("l_quantity"), g=F.round(F.col("l_partkey"), -2))),
            f"SELECT l_orderkey, l_partkey, round(l_extendedprice, 1) AS a, ceil(l_extendedprice) AS b, floor(l_extendedprice) AS c, trunc(-l_extendedprice) AS d, CAST(l_quantity / 2 AS INT) AS e, even(l_quantity) AS f, round(l_partkey, -2) AS g {_L}")
frame_query("num_powers", _numbers(lambda: dict(**{n: F.round(c, 8) for n, c in {"a": F.sqrt("l_quantity"), "b": F.cbrt("l_quantity"), "c": F.exp(F.col("l_tax")), "d": F.ln("l_quantity"), "e": N.log("l_quantity"), "f": F.log2("l_quantity"), "g": F.pow(F.col("l_tax"), F.lit(1.5)), "h": N.log("l_extendedprice", 3)}.items()})),
            f"SELECT l_orderkey, l_partkey, round(sqrt(l_quantity), 8) AS a, round(cbrt(l_quantity), 8) AS b, round(exp(l_tax), 8) AS c, round(ln(l_quantity), 8) AS d, round(log(l_quantity), 8) AS e, round(log2(l_quantity), 8) AS f, round(pow(l_tax, 1.5), 8) AS g, round(log(3, l_extendedprice), 8) AS h {_L}")
frame_query("num_trig", _numbers(lambda: dict(**{f"t_{f}": F.round(getattr(F, f)("l_discount"), 8) for f in _TRIG}, cot=F.round(F.cot(F.col("l_quantity")), 8), a2=F.round(F.atan2("l_tax", "l_discount"), 8))),
            f"SELECT l_orderkey, l_partkey, {', '.join(f'round({f}(l_discount), 8) AS t_{f}' for f in _TRIG)}, round(cot(l_quantity), 8) AS cot, round(atan2(l_tax, l_discount), 8) AS a2 {_L}")
frame_query("num_special", _numbers(lambda: dict(a=F.signum(F.col("l_discount") - 0.05), b=N.factorial(F.col("l_linenumber")).cast("long"), c=N.gcd("l_partkey", "l_suppkey"), d=N.lcm("l_partkey", F.col("l_suppkey") + 1), e=F.round(N.gamma(F.col("l_linenumber").cast("double")), 6), f=F.round(N.lgamma("l_quantity"), 8), g=N.greatest("l_partkey", "l_suppkey", F.lit(None)), h=F.least("l_partkey", "l_suppkey"), i=N.signbit(F.col("l_discount") - 0.05))),
            f"SELECT l_orderkey, l_partkey, CAST(sign(l_discount - 0.05) AS DOUBLE) AS a, CAST(factorial(l_linenumber) AS BIGINT) AS b, CAST(gcd(l_partkey, l_suppkey) AS BIGINT) AS c, CAST(lcm(l_partkey, l_suppkey + 1) AS BIGINT) AS d, round(gamma(l_linenumber), 6) AS e, round(lgamma(l_quantity), 8) AS f, greatest(l_partkey, l_suppkey, NULL) AS g, least(l_partkey, l_suppkey) AS h, signbit(l_discount - 0.05) AS i {_L}")
frame_query("num_classes", _numbers(lambda: dict(a=F.isnan(N.fdivide(F.col("l_linenumber") - 3, F.col("l_linenumber") - 3)), b=N.isinf(N.fdivide("l_quantity", F.col("l_linenumber") - 3)), c=N.isfinite(N.fdivide("l_quantity", F.col("l_linenumber") - 3)))),
            f"SELECT l_orderkey, l_partkey, l_linenumber = 3 AS a, isinf(l_quantity / (l_linenumber - 3)) AS b, isfinite(l_quantity / (l_linenumber - 3)) AS c {_L}")
sql_query("num_bits", "lineitem", f"SELECT l_orderkey, l_partkey, l_partkey & 12 AS a, l_partkey | 3 AS o, l_partkey ^ l_suppkey AS x, ~l_partkey AS n, shiftleft(l_partkey, 2) AS sl, shiftright(l_partkey, 3) AS sr, bit_count(l_partkey) AS c {_L}",
          f"SELECT l_orderkey, l_partkey, l_partkey & 12 AS a, l_partkey | 3 AS o, xor(l_partkey, l_suppkey) AS x, ~l_partkey AS n, l_partkey << 2 AS sl, l_partkey >> 3 AS sr, CAST(bit_count(l_partkey) AS INT) AS c {_L}")
frame_query("num_bitstring", _numbers(lambda: dict(a=N.bitstring(F.bin("l_partkey"), 16), b=N.get_bit(N.bitstring(F.bin("l_partkey"), 16), 15), c=N.set_bit(N.bitstring(F.bin("l_partkey"), 16), 0, 1), d=N.bit_position("1", N.bitstring(F.bin("l_partkey"), 16)).cast("int"))),
            f"SELECT l_orderkey, l_partkey, lpad(bin(l_partkey), 16, '0') AS a, get_bit(lpad(bin(l_partkey), 16, '0')::BIT, 15) AS b, set_bit(lpad(bin(l_partkey), 16, '0')::BIT, 0, 1)::VARCHAR AS c, bit_position('1'::BIT, lpad(bin(l_partkey), 16, '0')::BIT) AS d {_L}")

_HALVES = {"a": "nullif(l_partkey % 12, 5)", "b": "nullif(l_suppkey % 18, 7)"}
frame_query("num_gcd_nulls", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(x).alias(n) for n, x in _HALVES.items()]).select("l_orderkey", "l_linenumber", N.gcd("a", "b").alias("g"), N.lcm("a", "b").alias("m")),
            f"SELECT l_orderkey, l_linenumber, CAST(gcd({_HALVES['a']}, {_HALVES['b']}) AS BIGINT) AS g, CAST(lcm({_HALVES['a']}, {_HALVES['b']}) AS BIGINT) AS m FROM lineitem")
sql_query("num_try_cast", "customer", "SELECT c_custkey, try_cast(right(c_name, 2) AS INT) AS a, try_cast(c_mktsegment AS INT) AS b, CAST(c_custkey AS DECIMAL(10, 2)) AS c, CAST(c_custkey AS STRING) AS s FROM customer", "SELECT c_custkey, try_cast(right(c_name, 2) AS INT) AS a, try_cast(c_mktsegment AS INT) AS b, CAST(c_custkey AS DECIMAL(10, 2)) AS c, CAST(c_custkey AS VARCHAR) AS s FROM customer")


def _vectors(s, d):
    e = table(s, d, "embeddings")
    other = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    pairs = e.join(other, how="cross")
    return pairs.select("vec_id", *[F.round(f("embedding", "q"), 4).alias(n) for n, f in (("ip", V.inner_product), ("dist", V.distance), ("cos", V.cosine_similarity), ("cd", V.cosine_distance), ("nip", V.negative_inner_product))])


frame_query("vec_distances", _vectors, """SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 4) AS ip, round(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 4) AS dist, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 4) AS cos,
 round(list_cosine_distance(embedding::DOUBLE[], q::DOUBLE[]), 4) AS cd, round(list_negative_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 4) AS nip FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)""")
frame_query("vec_cross", lambda s, d: table(s, d, "embeddings").select("vec_id", F.transform(V.cross_product(F.slice("embedding", 1, 3).cast("array<double>"), F.slice("embedding", 4, 3).cast("array<double>")), lambda x: F.round(x, 8)).alias("c")),
            "SELECT vec_id, list_transform([a[2] * b[3] - a[3] * b[2], a[3] * b[1] - a[1] * b[3], a[1] * b[2] - a[2] * b[1]], lambda x: round(x, 8)) AS c FROM (SELECT vec_id, embedding[1:3]::DOUBLE[] AS a, embedding[4:6]::DOUBLE[] AS b FROM embeddings)")
