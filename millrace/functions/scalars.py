"""Scalar function families, all in the JVM.

Each column is given twice: as an expression of Spark and as DuckDB's for the same value. Functions that
DuckDB lacks, or defines otherwise, are applied to constants and compared with fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import register
from millrace.sources.tables import table


def family(name: str, source: str, key: str, columns: dict[str, tuple[str, str]], where: str | None = None) -> None:
    """Register key and the columns, each (Spark's expression, DuckDB's), over the source table; where holds in both."""
    sql = ", ".join(f"{duck} AS {column}" for column, (_, duck) in columns.items())

    @register(name, f"SELECT {key}, {sql} FROM {source}" + (f" WHERE {where}" if where else ""))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source)
        return (rows.where(where) if where else rows).selectExpr(key, *[f"{ours} AS {column}" for column, (ours, _) in columns.items()])


def both(expression: str) -> tuple[str, str]:
    return expression, expression


family(
    "fn_string",
    "customer",
    "c_custkey",
    {
        "joined": both("concat_ws('-', c_name, c_mktsegment)"),
        "head": both("substring(c_name, 1, 4)"),
        "ends": both("left(c_name, 3) || right(c_name, 2)"),
        "padded": ("lpad(cast(c_nationkey AS string), 4, '0')", "lpad(CAST(c_nationkey AS VARCHAR), 4, '0')"),
        "wide": both("rpad(c_mktsegment, 12, '.')"),
        "trimmed": both("trim(ltrim('  x ') || rtrim(' y  '))"),
        "cases": both("lower(c_name) || upper(c_mktsegment)"),
        "back": both("reverse(c_mktsegment)"),
        "swapped": both("replace(c_name, 'C', 'K')"),
        "mapped": both("translate(c_mktsegment, 'AEIOU', '4310')"),
        "part": both("split_part(c_name, '_', 2)"),
        "at": ("locate('I', c_mktsegment)", "CAST(strpos(c_mktsegment, 'I') AS INTEGER)"),
        "n": ("length(c_name)", "CAST(length(c_name) AS INTEGER)"),
        "edits": ("levenshtein(c_mktsegment, 'BUILDING')", "CAST(levenshtein(c_mktsegment, 'BUILDING') AS INTEGER)"),
        "xs": both("repeat('x', c_nationkey % 4)"),
        "formatted": ("format_string('%05d-%s', c_custkey, c_name)", "printf('%05d-%s', c_custkey, c_name)"),
        "code": ("ascii(c_mktsegment)", "ascii(c_mktsegment)"),
        "letter": both("chr(65 + c_nationkey)"),
        "begins": ("startswith(c_mktsegment, 'B')", "starts_with(c_mktsegment, 'B')"),
        "sound": ("soundex('Robert')", "'R163'"),
        "capitals": ("initcap('big data')", "'Big Data'"),
        "upto": ("substring_index('a.b.c', '.', 2)", "'a.b'"),
        "laid": ("overlay('abcdef' PLACING '_' FROM 3)", "'ab_def'"),
        "parsed": ("sentences('Hello there. Bye!')", "[['Hello', 'there'], ['Bye']]"),
    },
)

family(
    "fn_regex",
    "events",
    "event_id",
    {
        "digits": both("regexp_extract(props, '[0-9]+', 0)"),
        "masked": ("regexp_replace(props, '[0-9]', '#')", "regexp_replace(props, '[0-9]', '#', 'g')"),
        "seven": ("rlike(props, '7')", "regexp_matches(props, '7')"),
        "each": ("regexp_extract_all(props, '([0-9])', 1)", "regexp_extract_all(props, '[0-9]')"),
        "n": ("regexp_count(props, '[0-9]')", "CAST(len(regexp_extract_all(props, '[0-9]')) AS INTEGER)"),
        "at": ("regexp_instr(props, '[0-9]+')", "CAST(strpos(props, regexp_extract(props, '[0-9]+')) AS INTEGER)"),
        "found": ("regexp_substr(props, '[a-z]')", "regexp_extract(props, '[a-z]')"),
    },
)

family(
    "fn_hash_encode",
    "customer",
    "c_custkey",
    {
        "m": both("md5(c_name)"),
        "s1": ("sha1(c_name)", "sha1(c_name)"),
        "s": ("sha2(c_name, 256)", "sha256(c_name)"),
        "b": ("base64(encode(c_name, 'UTF-8'))", "base64(encode(c_name))"),
        "h": ("hex(c_name)", "hex(encode(c_name))"),
        "plain": ("decode(unbase64(base64(encode(c_name, 'UTF-8'))), 'UTF-8')", "c_name"),
        "unhexed": ("decode(unhex(hex(c_name)), 'UTF-8')", "c_name"),
        "url": ("url_encode(c_name || '&x=1')", "url_encode(c_name || '&x=1')"),
        "url_back": ("url_decode(url_encode(c_name || ' &'))", "c_name || ' &'"),
        "crc": ("crc32('Spark')", "CAST(1557323817 AS BIGINT)"),
        "xx": ("xxhash64('Spark')", "CAST(-4294468057691064905 AS BIGINT)"),
        "query": ("parse_url('http://h.org/p?q=1', 'QUERY')", "'q=1'"),
    },
)

family(
    "fn_date",
    "orders",
    "o_orderkey",
    {
        "y": ("year(o_orderdate)", "CAST(year(o_orderdate) AS INTEGER)"),
        "q": ("quarter(o_orderdate)", "CAST(quarter(o_orderdate) AS INTEGER)"),
        "m": ("extract(MONTH FROM o_orderdate)", "CAST(month(o_orderdate) AS INTEGER)"),
        "week": ("weekofyear(o_orderdate)", "CAST(weekofyear(o_orderdate) AS INTEGER)"),
        "doy": ("dayofyear(o_orderdate)", "CAST(dayofyear(o_orderdate) AS INTEGER)"),
        "dow": ("dayofweek(o_orderdate)", "CAST(dayofweek(o_orderdate) + 1 AS INTEGER)"),
        "hms": ("hour(o_orderdate) * 3600 + minute(o_orderdate) * 60", "CAST(hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 AS INTEGER)"),
        "first_of": ("cast(date_trunc('month', o_orderdate) AS date)", "CAST(date_trunc('month', o_orderdate) AS DATE)"),
        "last_of": ("last_day(o_orderdate)", "CAST(last_day(o_orderdate) AS DATE)"),
        "later": ("add_months(o_orderdate, 1)", "CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE)"),
        "tomorrow": ("date_add(o_orderdate, 1)", "CAST(CAST(o_orderdate AS DATE) + 1 AS DATE)"),
        "before": ("date_sub(o_orderdate, 7)", "CAST(CAST(o_orderdate AS DATE) - 7 AS DATE)"),
        "days": ("datediff(o_orderdate, date'1995-01-01')", "CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INTEGER)"),
        "text": ("date_format(o_orderdate, 'yyyy/MM/dd')", "strftime(o_orderdate, '%Y/%m/%d')"),
        "monday": ("next_day(o_orderdate, 'MON')", "CAST(date_trunc('week', o_orderdate) + INTERVAL 7 DAY AS DATE)"),
        "built": ("make_date(year(o_orderdate), 1, 15)", "make_date(year(o_orderdate), 1, 15)"),
        "parsed": ("to_date('2024-02-29', 'yyyy-MM-dd')", "DATE '2024-02-29'"),
        "between_months": ("months_between('1997-02-28 10:30:00', '1996-10-30')", "CAST(3.94959677 AS DOUBLE)"),
        "tokyo": ("convert_timezone('UTC', 'Asia/Tokyo', timestamp_ntz'2024-01-01 00:00:00')", "TIMESTAMP '2024-01-01 09:00:00'"),
        "moved": ("o_orderdate + make_dt_interval(1, 2, 3, 4)", "o_orderdate + INTERVAL '1 day 2 hours 3 minutes 4 seconds'"),
        "years_on": ("timestamp_ntz'2024-02-29 00:00:00' + make_ym_interval(1, 1)", "TIMESTAMP '2025-03-29 00:00:00'"),
    },
)

family(
    "fn_math",
    "part",
    "p_partkey",
    {
        "a": both("abs(p_size - 25)"),
        "c": ("ceil(p_retailprice)", "CAST(ceil(p_retailprice) AS BIGINT)"),
        "f": ("floor(p_retailprice)", "CAST(floor(p_retailprice) AS BIGINT)"),
        "s": both("round(sqrt(p_retailprice), 6)"),
        "cube": both("round(cbrt(p_retailprice), 6)"),
        "l": both("round(ln(p_size), 6)"),
        "logs": ("round(log10(p_size) + log2(p_size), 6)", "round(log10(p_size) + log2(p_size), 6)"),
        "e": both("round(exp(p_size / 25.0e0), 6)"),
        "p": both("round(pow(p_size, 2), 6)"),
        "trig": both("round(sin(p_size) + cos(p_size) + atan2(p_size, 3), 6)"),
        "angle": both("round(degrees(atan(p_size)) + radians(p_size), 6)"),
        "m": both("p_size % 7"),
        "pm": ("pmod(p_size - 25, 7)", "((p_size - 25) % 7 + 7) % 7"),
        "d": ("p_size div 7", "CAST(p_size // 7 AS BIGINT)"),
        "x": ("p_size ^ 5", "xor(p_size, 5)"),
        "bits": ("(p_size & 6) | shiftleft(p_size, 2)", "(p_size & 6) | (p_size << 2)"),
        "ones": ("bit_count(p_size)", "CAST(bit_count(p_size) AS INTEGER)"),
        "sign": ("sign(p_size - 25e0)", "CAST(sign(p_size - 25) AS DOUBLE)"),
        "even": ("cast(bround(p_size / 2.0, 0) AS int)", "CAST(CASE WHEN p_size % 2 = 0 THEN p_size // 2 WHEN (p_size // 2) % 2 = 0 THEN p_size // 2 ELSE p_size // 2 + 1 END AS INTEGER)"),
        "bucket": ("width_bucket(p_size, 0, 50, 5)", "CAST(CASE WHEN p_size >= 50 THEN 6 ELSE p_size // 10 + 1 END AS BIGINT)"),
        "safe": ("try_divide(p_size, p_size % 2)", "CASE WHEN p_size % 2 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END"),
        "over": ("try_add(2147483647, p_size)", "CAST(NULL AS INTEGER)"),
        "based": ("conv('ff', 16, 10)", "'255'"),
        "product": ("factorial(5)", "CAST(120 AS BIGINT)"),
    },
)


@register(
    "fn_array",
    """SELECT item_id, CAST(len(w) AS INTEGER) AS n, w[1] AS first, list_contains(w, 'the') AS the, array_to_string(list_sort(list_distinct(w)), ' ') AS uniq,
       CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS chars, CAST(len(list_filter(w, lambda x: length(x) > 5)) AS INTEGER) AS long,
       w[2:4] AS some, list_sort(list_distinct(list_concat(w[1:3], w[2:5]))) AS either, list_sort(list_intersect(w[1:3], w[2:5])) AS common, list_sort(list_filter(list_distinct(w[1:3]), lambda x: NOT list_contains(w[2:5], x))) AS only,
       list_concat(w[1:1], w[2:3]) AS flat, len(list_filter(w, lambda x: length(x) < 1)) = 0 AS every, len(list_filter(w, lambda x: length(x) > 9)) > 0 AS any,
       list_transform(range(1, 3), lambda i: w[i] || w[i + 1]) AS zipped, CAST(list_position(w, w[3]) AS BIGINT) AS at, [2, 5, 8] AS steps, [item_id, item_id] AS twice, w[len(w)] AS last FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark) WHERE len(w) >= 5""",
)
def fn_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, tail = F.slice("w", 1, 3), F.slice("w", 2, 4)
    return table(spark, sf_dir, "benchmark").withColumn("w", F.split("text", " ")).where(F.size("w") >= 5).select(
        "item_id",
        F.size("w").alias("n"),
        F.element_at("w", 1).alias("first"),
        F.array_contains("w", "the").alias("the"),
        F.array_join(F.array_sort(F.array_distinct("w")), " ").alias("uniq"),
        F.aggregate("w", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("chars"),
        F.size(F.filter("w", lambda x: F.length(x) > 5)).alias("long"),
        F.slice("w", 2, 3).alias("some"),
        F.array_sort(F.array_union(head, tail)).alias("either"),
        F.array_sort(F.array_intersect(head, tail)).alias("common"),
        F.array_sort(F.array_except(head, tail)).alias("only"),
        F.flatten(F.array(F.slice("w", 1, 1), F.slice("w", 2, 2))).alias("flat"),
        F.forall("w", lambda x: F.length(x) >= 1).alias("every"),
        F.exists("w", lambda x: F.length(x) > 9).alias("any"),
        F.zip_with(F.slice("w", 1, 2), F.slice("w", 2, 2), lambda a, b: F.concat(a, b)).alias("zipped"),
        F.array_position("w", F.element_at("w", 3)).alias("at"),
        F.sequence(F.lit(2), F.lit(8), F.lit(3)).alias("steps"),
        F.array_repeat("item_id", 2).alias("twice"),
        F.element_at("w", -1).alias("last"),
    )


@register(
    "fn_map",
    """SELECT n_nationkey, lower(n_name) AS v, 2 AS entries, ['name', 'region'] AS keys, [n_name, CAST(n_regionkey AS VARCHAR)] AS vals, ['name'] AS filtered, 'NAME' AS raised,
       n_name || '/' || CAST(n_regionkey AS VARCHAR) AS pairs, n_name || '+' || n_name AS zipped, 3 AS merged, true AS has, '2' AS parsed, n_name AS again FROM nation""",
)
def fn_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.map_from_arrays(F.array(F.lit("name"), F.lit("region")), F.array(F.col("n_name"), F.col("n_regionkey").cast("string")))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", made.alias("m"))
    lowered = F.transform_values("m", lambda k, v: F.when(k == "name", F.lower(v)).otherwise(v))
    entries = F.map_entries("m")
    return rows.select(
        "n_nationkey",
        F.element_at(lowered, "name").alias("v"),
        F.size(F.map_keys(lowered)).alias("entries"),
        F.map_keys("m").alias("keys"),
        F.map_values("m").alias("vals"),
        F.map_keys(F.map_filter("m", lambda k, v: k == "name")).alias("filtered"),
        F.element_at(F.map_keys(F.transform_keys("m", lambda k, v: F.upper(k))), 1).alias("raised"),
        F.array_join(F.transform(entries, lambda e: e["value"]), "/").alias("pairs"),
        F.element_at(F.map_zip_with("m", "m", lambda k, a, b: F.concat(a, F.lit("+"), b)), "name").alias("zipped"),
        F.size(F.map_concat("m", F.create_map(F.lit("x"), F.lit("y")))).alias("merged"),
        F.map_contains_key("m", "region").alias("has"),
        F.element_at(F.expr("str_to_map('a:1,b:2')"), "b").alias("parsed"),
        F.element_at(F.map_from_entries(entries), "name").alias("again"),
    )


NUMBER = "regexp_matches(json_extract_string(props, '$.k'), '^[0-9]+$')"


@register(
    "fn_json",
    f"""SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS next, json_extract_string(props, '$.k') AS tuple, '{{"k":' || json_extract_string(props, '$.k') || '}}' AS made,
        3 AS n, ['a', 'b'] AS keys FROM events WHERE {NUMBER}""",
)
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    parsed = F.from_json("props", "k long")
    events = table(spark, sf_dir, "events").where(k.rlike("^[0-9]+$")).select("*", F.json_tuple("props", "k").alias("tuple"))
    return events.select(
        "event_id",
        k.alias("k"),
        (parsed["k"] + 1).alias("next"),
        "tuple",
        F.to_json(parsed).alias("made"),
        F.json_array_length(F.lit("[1, 2, 3]")).alias("n"),
        F.json_object_keys(F.lit('{"a": 1, "b": 2}')).alias("keys"),
    )


family(
    "fn_conditional",
    "orders",
    "o_orderkey",
    {
        "done": both("CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END"),
        "g": both("greatest(o_orderkey, o_custkey)"),
        "l": both("least(o_orderkey, o_custkey)"),
        "s": both("nullif(o_orderstatus, 'O')"),
        "filled": both("coalesce(nullif(o_orderstatus, 'O'), 'open')"),
        "second": ("nvl2(nullif(o_orderstatus, 'O'), 'yes', 'no')", "CASE WHEN nullif(o_orderstatus, 'O') IS NOT NULL THEN 'yes' ELSE 'no' END"),
        "first": ("nvl(nullif(o_orderstatus, 'O'), 'none')", "ifnull(nullif(o_orderstatus, 'O'), 'none')"),
        "chosen": ("if(o_totalprice > 200000, 'high', 'low')", "if(o_totalprice > 200000, 'high', 'low')"),
        "kind": ("typeof(o_orderkey)", "lower(typeof(o_orderkey))"),
        "nan": ("isnan(CASE WHEN o_orderstatus = 'F' THEN double('NaN') ELSE o_totalprice END)", "isnan(CASE WHEN o_orderstatus = 'F' THEN 'nan'::DOUBLE ELSE o_totalprice END)"),
        "number": ("nanvl(CASE WHEN o_orderstatus = 'F' THEN double('NaN') ELSE o_totalprice END, -1.0e0)", "CASE WHEN o_orderstatus = 'F' THEN CAST(-1 AS DOUBLE) ELSE o_totalprice END"),
        "same": ("nullif(o_orderstatus, 'O') <=> NULL", "nullif(o_orderstatus, 'O') IS NOT DISTINCT FROM NULL"),
    },
)


@register("fn_variant", f"SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS number, 'k' AS key, 'BIGINT' AS kind, json_extract_string(props, '$.k') AS value, CAST(NULL AS VARCHAR) AS missing FROM events WHERE {NUMBER}")
def fn_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' own JSON as variants: paths, types, and a row for each entry."""
    rows = table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").rlike("^[0-9]+$")).select("event_id", F.parse_json("props").alias("v"))
    return spark.sql(
        """SELECT event_id, variant_get(v, '$.k', 'bigint') AS number, e.key, schema_of_variant(e.value) AS kind, to_json(e.value) AS value, try_variant_get(v, '$.none', 'string') AS missing
           FROM {rows}, LATERAL variant_explode(v) AS e""",
        rows=rows,
    )


@register("fn_text_other", "SELECT n_nationkey, n_nationkey || ',' || n_name AS csv, n_name AS name, n_regionkey AS region, n_regionkey AS parsed, [n_name] AS names FROM nation")
def fn_text_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV and XML made from columns and read again."""
    csv = F.to_csv(F.struct("n_nationkey", "n_name"))
    xml = F.concat(F.lit("<n><region>"), F.col("n_regionkey"), F.lit("</region><name>"), F.col("n_name"), F.lit("</name></n>"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", csv.alias("csv"), xml.alias("xml"))
    return rows.select(
        "n_nationkey",
        "csv",
        F.from_csv("csv", "k int, name string")["name"].alias("name"),
        F.expr("xpath_int(xml, 'n/region')").alias("region"),
        F.from_xml("xml", "region int, name string")["region"].alias("parsed"),
        F.expr("xpath(xml, 'n/name/text()')").alias("names"),
    )


@register(
    "fn_vector",
    """SELECT a.vec_id, round(list_inner_product(a.x, a.x), 6) AS norm2, round(list_inner_product(a.x, b.x), 6) AS dot, round(list_cosine_similarity(a.x, b.x), 6) AS cosine, round(list_distance(a.x, b.x), 6) AS distance
       FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) b ON b.vec_id = a.vec_id + 1""",
)
def fn_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector beside the next one by id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))
    return pairs.select("vec_id", *[F.round(v, 6).alias(k) for k, v in {"norm2": dot("x", "x"), "dot": dot("x", "y"), "cosine": cosine, "distance": F.sqrt(apart)}.items()])
