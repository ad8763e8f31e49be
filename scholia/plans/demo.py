"""Queries over the provided tables, one or more for each operator, with their SQL for DuckDB. The tables hold no
bibliographies, so identifiers, names and entries are derived from keys by rules that both sides can state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import checks, identifiers, patterns, text
from scholia.operators import bibliography as B
from scholia.options import Options
from scholia.plans import generated, onefile
from scholia.sources import config

FLAGSHIP = "q_prettyprint"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pad(n: Column, width: int) -> Column:
    return F.lpad((n % 10**width).cast("string"), width, "0")


def _spell(c: Column, at: str) -> Column:
    """The character of a string at position c, from 0."""
    return F.substring(F.lit(at), (c + 1).cast("int"), F.lit(1))


# identifiers


def _issn(d: DataFrame) -> DataFrame:
    seven = _pad(F.col("p_partkey") * 7919, 7)
    total = sum(F.substring(seven, k, 1).cast("int") * (k + 2) for k in range(1, 8))
    check = _spell((total + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)) % 11, "0123456789X")
    return d.select("p_partkey", F.concat(F.substring(seven, 1, 4), F.lit("-"), F.substring(seven, 5, 3), check).alias("issn"))


_ISSN_SQL = """WITH s AS (SELECT p_partkey, lpad(CAST((p_partkey * 7919) % 10000000 AS VARCHAR), 7, '0') AS seven FROM part),
c AS (SELECT *, list_sum(list_transform(range(1, 8), lambda k: CAST(substr(seven, k, 1) AS BIGINT) * (k + 2))) AS total FROM s),
i AS (SELECT p_partkey, substr(seven, 1, 4) || '-' || substr(seven, 5, 3) || substr('0123456789X', CAST((total + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) % 11 + 1 AS BIGINT), 1) AS issn FROM c)
"""


def q_issn_check(spark, d):
    return _issn(_t(spark, d, "part")).withColumn("valid", identifiers.issn_valid(F.col("issn")))


def _isbn10(d: DataFrame) -> DataFrame:
    nine = _pad(F.col("o_orderkey") * 48271, 9)
    total = sum(F.substring(nine, k, 1).cast("int") * k for k in range(1, 10))
    return d.select("o_orderkey", F.concat(nine, _spell((total + F.when(F.col("o_orderkey") % 7 == 0, 3).otherwise(0)) % 11, "0123456789X")).alias("isbn"))


_ISBN10_SQL = """WITH s AS (SELECT o_orderkey, lpad(CAST((o_orderkey * 48271) % 1000000000 AS VARCHAR), 9, '0') AS nine FROM orders),
c AS (SELECT *, list_sum(list_transform(range(1, 10), lambda k: CAST(substr(nine, k, 1) AS BIGINT) * k)) AS total FROM s),
i AS (SELECT o_orderkey, nine || substr('0123456789X', CAST((total + CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 0 END) % 11 + 1 AS BIGINT), 1) AS isbn FROM c)
"""


def q_isbn10_check(spark, d):
    return _isbn10(_t(spark, d, "orders")).withColumn("valid", identifiers.isbn10_valid(F.col("isbn")))


def q_isbn13_check(spark, d):
    keys = _t(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("k")).union(_t(spark, d, "supplier").select(F.lit("supplier"), F.col("s_suppkey")))
    twelve = F.concat(F.when(F.col("k") % 9 == 0, "977").otherwise("978"), _pad(F.col("k") * 16807, 9))
    total = sum(F.substring(twelve, k, 1).cast("int") * (1 if k % 2 else 3) for k in range(1, 13))
    isbn = F.concat(twelve, ((10 - (total + F.when(F.col("k") % 4 == 0, 1).otherwise(0)) % 10) % 10).cast("string"))
    return keys.select("source", "k", isbn.alias("isbn")).withColumn("valid", identifiers.isbn13_valid(F.col("isbn")))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def q_coden_check(spark, d):
    k = F.col("p_partkey")
    five = F.concat(*(_spell(F.floor(k * 7 / 26**j) % 26, _LETTERS) for j in range(5)))
    value = F.when(k % 4 == 0, five).when(k % 4 == 1, F.concat(five, identifiers.coden_check(five))).otherwise(F.concat(five, _spell(k % 34, identifiers.CODEN_CHECK)))
    return _t(spark, d, "part").select("p_partkey", value.alias("coden")).withColumn("verdict", identifiers.coden_verdict(F.col("coden"))).withColumn("suggested", identifiers.coden_check(F.substring("coden", 1, 5)))


_CODEN_SQL = f"""WITH s AS (SELECT p_partkey, list_aggregate(list_transform(range(0, 5), lambda j: substr('{_LETTERS}', CAST(CAST(floor(p_partkey * 7 / pow(26, j)) AS BIGINT) % 26 + 1 AS BIGINT), 1)), 'string_agg', '') AS five FROM part),
w AS (SELECT *, substr('{identifiers.CODEN_CHECK}', CAST(((ascii(substr(five, 1, 1)) - 64) * 11 + (ascii(substr(five, 2, 1)) - 64) * 7 + (ascii(substr(five, 3, 1)) - 64) * 5 + (ascii(substr(five, 4, 1)) - 64) * 3 + (ascii(substr(five, 5, 1)) - 64)) % 34 + 1 AS BIGINT), 1) AS suggested FROM s),
c AS (SELECT p_partkey, suggested, CASE WHEN p_partkey % 4 = 0 THEN five WHEN p_partkey % 4 = 1 THEN five || suggested ELSE five || substr('{identifiers.CODEN_CHECK}', CAST(p_partkey % 34 + 1 AS BIGINT), 1) END AS coden FROM w)
SELECT p_partkey, coden, CASE WHEN length(coden) = 5 THEN 'incomplete' WHEN substr(coden, 6, 1) = suggested THEN 'ok' ELSE 'invalid' END AS verdict, suggested FROM c"""


def _ranges_sql() -> str:
    return "(VALUES " + ", ".join(f"({k}, '{b.replace('-', '')}', '{e.replace('-', '')}', {len(b.split('-')[0])})" for k, (b, e) in enumerate(identifiers.ISBN_RANGES)) + ") AS r(ord, low, high, g)"


def q_isbn_hyphenate(spark, d):
    return _isbn10(_t(spark, d, "orders")).withColumn("hyphenated", identifiers.hyphenate_isbn(F.col("isbn")))


def q_isbn_range_join(spark, d):
    """How many numbers fall into each range: an equi join on the first three digits. A range stands once for each
    three-digit prefix that it touches (at most 1000 for all of its length), so a number meets only the ranges of its prefix."""
    bare = [(k, b.replace("-", ""), e.replace("-", "")) for k, (b, e) in enumerate(identifiers.ISBN_RANGES)]
    rows = [(k, lo, hi, len(lo), f"{p:03}") for k, lo, hi in bare for p in range(int(f"{lo:0<3}"[:3]), int(f"{hi:9<3}"[:3]) + 1)]
    ranges = spark.createDataFrame(rows, "ord int, low string, high string, n int, prefix string")
    isbn = _isbn10(_t(spark, d, "orders")).withColumn("prefix", F.substring("isbn", 1, 3))
    hit = isbn.join(F.broadcast(ranges), "prefix").filter((F.expr("substring(isbn, 1, n)") >= F.col("low")) & (F.expr("substring(isbn, 1, n)") <= F.col("high")))
    return hit.groupBy("ord", "low", "high").agg(F.count("*").alias("n_isbn"))


def _nation_ranges(spark, d) -> DataFrame:
    """A table of ranges in which the first range of each nation's group names the nation."""
    spans = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(a).alias("a"), F.lit(b).alias("b")) for j, (a, b) in enumerate((("00", "19"), ("200", "699"), ("7000", "8999")))))
    n = _t(spark, d, "nation").select("n_nationkey", "n_name", F.explode(spans).alias("s"))
    group = (F.col("n_nationkey") + 600).cast("string")
    return n.select((F.col("n_nationkey") * 3 + F.col("s.j")).cast("int").alias("ord"), F.concat(group, F.lit("-"), F.col("s.a")).alias("begin"), F.concat(group, F.lit("-"), F.col("s.b")).alias("end"), F.when(F.col("s.j") == 0, F.col("n_name")).otherwise("").alias("countries"))


def q_isbn_countries(spark, d):
    """How many numbers fall into each country's ranges, countries carried forward in their group."""
    k = F.col("o_orderkey")
    numbers = _t(spark, d, "orders").select(F.concat((k % 30 + 600).cast("string"), _pad(k * 48271, 6), F.lit("0")).alias("ten"))
    found = config.join_ranges(numbers, config.with_countries(_nation_ranges(spark, d)))
    return found.groupBy(F.coalesce("range.begin", F.lit("")).alias("begin"), F.coalesce("range.countries", F.lit("")).alias("countries")).agg(F.count("*").alias("n"))


def q_isbn_printed(spark, d):
    """The table as it is printed, a country where it changes."""
    return config.printed_ranges(config.with_countries(_nation_ranges(spark, d)))


_NATION_RANGES_SQL = """WITH r AS (SELECT CAST(n_nationkey * 3 + v.j AS INT) AS ord, (600 + n_nationkey) || '-' || v.a AS "begin", (600 + n_nationkey) || '-' || v.b AS "end", n_name AS countries, v.j, (600 + n_nationkey) || v.a AS low, (600 + n_nationkey) || v.b AS high
FROM nation, LATERAL (VALUES (0, '00', '19'), (1, '200', '699'), (2, '7000', '8999')) AS v(j, a, b))"""


def _roman(n: Column) -> Column:
    out = F.lit("")
    for base, digits in ((1000, ("", "M", "MM", "MMM")), (100, ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM")), (10, ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")), (1, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))):
        out = F.concat(out, F.element_at(F.array(*map(F.lit, digits)), (F.floor(n / base) % 10 + 1).cast("int")))
    return out


def q_roman(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("expected"), identifiers.roman_to_int(F.concat(_roman(F.col("p_size")), F.lit(" pages"))).cast("long").alias("value"))


# checks


def q_year_check(spark, d):
    k = F.col("o_orderkey")
    year = F.when(k % 5 == 0, F.year("o_orderdate")).when(k % 5 == 1, 1454).when(k % 5 == 2, 1455).when(k % 5 == 3, 2099).otherwise(2100)
    value = F.concat(F.lit('"'), year.cast("string"), F.when(k % 2 == 0, ", 1999").otherwise(""), F.lit('"'))
    return _t(spark, d, "orders").select("o_orderkey", value.alias("year")).withColumn("suspicious", checks.suspicious_years(F.col("year")).cast("long"))


def q_url_check(spark, d):
    k, u = F.col("page_id"), F.col("url")
    value = F.when(k % 5 == 0, u).when(k % 5 == 1, F.concat(F.lit("gopher://host/"), k.cast("string"))).when(k % 5 == 2, F.regexp_replace(u, "^[a-z]+://", "")).when(k % 5 == 3, F.concat(F.lit("http://dx.doi.org/10.1000/"), k.cast("string"))).otherwise(F.concat(F.lit("https://www.example.com/10."), k.cast("string")))
    return _t(spark, d, "pages").select("page_id", value.alias("value")).select("page_id", "value", F.array_join(checks.url_codes(F.col("value")), ",").alias("codes"))


def q_doi_check(spark, d):
    k = F.col("p_partkey")
    doi = F.concat(F.lit("10."), (k % 9000 + 1000).cast("string"), F.when(k % 7 == 0, "/a b").when(k % 7 == 1, "/x,y").when(k % 7 == 2, "/p;q").otherwise("/v"), k.cast("string"))
    return _t(spark, d, "part").select("p_partkey", doi.alias("doi")).withColumn("separators", checks.doi_has_separators(F.col("doi")))


def q_length_check(spark, d):
    return _t(spark, d, "documents").filter(checks.too_long(F.col("text"))).select("doc_id", F.length("text").cast("long").alias("n"))


VOLUMES = ('"27"', '"27A"', '"27/3"', '"27A 3"', '"SMC-13"', '"VIII"', '"1.2"', '"11 and 12"', '"Special issue A"', '"!27"', '"{\\\\bf 27}"', '""')
PAGES = ('"23"', '"L23"', '"23--27"', '"L23--L27"', '"1:1--1:20"', '"23, 27"', '"viii + 445"', '"23-27"', '"??--??"', '"x y"')


def _chosen(spark, d, values: tuple[str, ...], field: str) -> DataFrame:
    value = F.element_at(F.array(*(F.lit(v.replace("\\\\", "\\")) for v in values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    rows = _t(spark, d, "part").select("p_partkey", value.alias("value"))
    return rows.withColumn("pattern", F.coalesce(patterns.first_match(F.col("value"), patterns.DEFAULT_PATTERNS[field]), F.lit(0)).cast("long"))


def q_pattern_volume(spark, d):
    return _chosen(spark, d, VOLUMES, "volume")


def q_pattern_pages(spark, d):
    return _chosen(spark, d, PAGES, "pages")


def _chosen_sql(values: tuple[str, ...], verdicts: tuple[int, ...]) -> str:
    rows = ", ".join(f"({k}, '{v.replace(chr(92) * 2, chr(92))}', {n})" for k, (v, n) in enumerate(zip(values, verdicts, strict=True)))
    return f"SELECT p_partkey, v.value, CAST(v.pattern AS BIGINT) AS pattern FROM part JOIN (VALUES {rows}) AS v(k, value, pattern) ON p_partkey % {len(values)} = v.k"


# scalar fixes


def q_month_macro(spark, d):
    return _t(spark, d, "orders").select(text.month_macro(F.date_format("o_orderdate", "MMMM")).alias("month")).groupBy("month").agg(F.count("*").alias("n"))


def q_pages_fix(spark, d):
    a, n = F.col("l_linenumber"), F.col("l_orderkey") % 4
    dash = F.when(n == 0, " - ").when(n == 1, "---").when(n == 2, "-").otherwise("-- -")
    raw = F.concat(F.lit('"'), a.cast("string"), dash, (a + 10).cast("string"), F.when(n == 3, ", A - 7").otherwise(""), F.lit('"'))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.fix_pages(raw).alias("pages")).groupBy("pages").agg(F.count("*").alias("n"))


def q_names_fix(spark, d):
    k = F.col("c_custkey")
    initial = lambda n: _spell(n % 26, _LETTERS)
    raw = F.concat(F.lit("Smith"), k.cast("string"), F.lit(", "), initial(k), F.lit("."), initial(k * 7), F.lit(". and Ann "), initial(k * 3), F.lit(".Jones and Lee, "), F.col("c_mktsegment"))
    return _t(spark, d, "customer").select("c_custkey", text.fix_names(raw).alias("names"))


def q_squeeze_space(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.squeeze_space(F.col("text")).alias("squeezed"))


# fields as rows

_RAW_NAMES = ("AUTHOR", "isbn-13", "OptNote", "coden", "Title", "ISSN", "optyear", "Url")
_OPTS = ("OPTnote", "note", "OPTyear", "OPT", "title")


def _named(spark, d, names: tuple[str, ...]) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    value = F.when(k % 3 == 0, '""').otherwise(F.concat(F.lit('"'), F.col("n_name"), F.lit('"')))
    return _t(spark, d, "nation").select("n_nationkey", name.alias("name"), value.alias("value"))


def _named_sql(names: tuple[str, ...]) -> str:
    return f"""n AS (SELECT n_nationkey, list_extract({list(names)!r}, n_nationkey % {len(names)} + 1) AS name, CASE WHEN n_nationkey % 3 = 0 THEN '""' ELSE '"' || n_name || '"' END AS value FROM nation)"""


def _entry_rows(rows: DataFrame) -> DataFrame:
    one = F.struct(F.lit(0).alias("seq"), F.col("name").alias("name"), F.col("value").alias("value"))
    return rows.select("n_nationkey", F.array(one).alias("fields"))


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("n_nationkey", F.explode("fields").alias("f")).select("n_nationkey", "f.name", "f.value")


def q_delete_empty(spark, d):
    return _exploded(B.drop_empty_fields(_entry_rows(_named(spark, d, _OPTS))))


def q_remove_opt(spark, d):
    return _exploded(B.remove_opt(_entry_rows(_named(spark, d, _OPTS))))


def q_field_case_map(spark, d):
    rows = _named(spark, d, _RAW_NAMES)
    return rows.select("n_nationkey", F.col("name").alias("raw"), text.field_name(F.col("name")).alias("name"))


def q_keyword_upsert(spark, d):
    base = _t(spark, d, "nation").select(F.lower("n_name").alias("old_name"), F.col("n_name").alias("new_name"))
    changes = _t(spark, d, "nation").filter("n_nationkey % 4 = 0").select(F.lower("n_name").alias("old_name"), F.concat(F.lit("xx"), F.col("n_name")).alias("new_name"), (F.col("n_nationkey") % 8 == 0).alias("deleted"))
    return config.upsert(base, changes)


# whole-text operators


def q_tokenize(spark, d):
    """Runs of each kind in all texts and their characters: sums of what each text holds, then a row for each kind."""
    counted = _t(spark, d, "documents").where("text is not null").select(*text.run_counts(F.col("text")))
    total = counted.agg(*(F.sum(c).alias(c) for c in counted.columns))
    kinds = F.array(*(F.struct(F.lit(k).alias("token_name"), F.col(f"{k}_n").alias("n"), F.col(f"{k}_chars").alias("chars")) for k in text.RUNS))
    return total.select(F.inline(kinds)).where("n > 0")


def q_duplicate_keys(spark, d):
    keys = _t(spark, d, "part").select(F.lit("entry").alias("kind"), F.substring("p_name", 1, 6).alias("cite_key"))
    return B.duplicate_keys(keys)


def q_sorted_keys(spark, d):
    return B.sorted_keys(_t(spark, d, "part").select(F.lit("entry").alias("kind"), F.substring("p_name", 1, 8).alias("cite_key")))


def q_like_search(spark, d):
    return _t(spark, d, "documents").filter(F.col("text").like("%token%") | (F.col("text").like("%the%") & F.col("text").like("%License%"))).select("doc_id", "lang", "source").orderBy("doc_id")


def q_error_count(spark, d):
    return _diagnosed(spark, d).groupBy("severity", "code").agg(F.count("*").alias("n"))


# the parser


def _bib(spark, d) -> DataFrame:
    """One file of 100 parts each: the key range is the file, so files are made without a window."""
    entry = F.format_string('@article{P%d,\n author = {%s},\n  TITLE="%s %s", isbn = "0-387-09823-2",\n pages = {%d - %d}, month = "January", year = %d\n}\n', "p_partkey", "p_brand", "p_name", "p_type", "p_partkey", F.col("p_partkey") + F.col("p_size"), F.col("p_size") + 1430)
    rows = _t(spark, d, "part").select(F.floor(F.col("p_partkey") / 100).alias("f"), F.struct(F.col("p_partkey").alias("k"), entry.alias("t")).alias("e"))
    return rows.groupBy("f").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e.t), "\n").alias("text")).select(F.format_string("part%05d.bib", "f").alias("file"), "text")


def _diagnosed(spark, d) -> DataFrame:
    return B.diagnostics(_bib(spark, d))


def q_parse_entries(spark, d):
    f = B.fields(B.entries(_bib(spark, d)))
    return f.select("file", "cite_key", "entry_name", F.col("seq").cast("long").alias("seq"), "name", "value")


def q_prettyprint(spark, d):
    return B.prettyprint(_bib(spark, d)).select("file", F.explode(F.split("text", "\n\n")).alias("entry")).select("file", F.rtrim("entry", F.lit("\n")).alias("entry"))


def q_lex(spark, d):
    return B.tokens(_bib(spark, d)).groupBy("token_name").agg(F.count("*").alias("n"))


def q_scribe(spark, d):
    entry = F.format_string("@Book(S%d,\n Key <%s>, Title = [%s], Year %d)\n", "s_suppkey", "s_name", "s_name", F.col("s_suppkey") % 90 + 1900)
    rows = _t(spark, d, "supplier").select(F.format_string("s%d.mss", "s_suppkey").alias("file"), entry.alias("text"))
    f = B.fields(B.entries(rows, Options(scribe=True)))
    return f.select("cite_key", F.col("seq").cast("long").alias("seq"), "name", "value")


def q_diagnostics(spark, d):
    return _diagnosed(spark, d).select("file", "cite_key", "severity", "code", B.message_line(F.col("severity"), F.col("file"), F.lit(0), F.col("message")).alias("message"))


_PARSED_SQL = """WITH p AS (SELECT *, printf('part%05d.bib', CAST(floor(p_partkey / 100) AS BIGINT)) AS file FROM part)
SELECT file, 'P' || p_partkey AS cite_key, 'Article' AS entry_name, CAST(seq AS BIGINT) AS seq, name, value FROM p,
LATERAL (VALUES (0, 'author', '"' || p_brand || '"'), (1, 'title', '"' || p_name || ' ' || p_type || '"'), (2, 'ISBN', '"0-387-09823-2"'),
  (3, 'pages', '"' || p_partkey || '--' || (p_partkey + p_size) || '"'), (4, 'month', 'jan'), (5, 'year', '"' || (p_size + 1430) || '"')) AS v(seq, name, value)"""

_PRETTY_SQL = """SELECT printf('part%05d.bib', CAST(floor(p_partkey / 100) AS BIGINT)) AS file,
'@Article{P' || p_partkey || ',' || chr(10) || '  author =       "' || p_brand || '",' || chr(10) || '  title =        "' || p_name || ' ' || p_type || '",' || chr(10)
|| '  ISBN =         "0-387-09823-2",' || chr(10) || '  pages =        "' || p_partkey || '--' || (p_partkey + p_size) || '",' || chr(10) || '  month =        jan,' || chr(10)
|| '  year =         "' || (p_size + 1430) || '",' || chr(10) || '}' AS entry FROM part"""

_DIAG_SQL = """d AS (SELECT p_partkey, printf('part%05d.bib', CAST(floor(p_partkey / 100) AS BIGINT)) AS file, p_size + 1430 AS y, v.code, v.head FROM part,
LATERAL (VALUES ('unexpected_value', 'Unexpected value in', 1), ('suspicious_year', 'Suspicious year in', CASE WHEN p_size + 1430 < 1455 THEN 1 ELSE 0 END)) AS v(code, head, there) WHERE v.there = 1)"""


def queries() -> dict:
    plain = (
        q_issn_check, q_isbn10_check, q_isbn13_check, q_coden_check, q_isbn_hyphenate, q_isbn_range_join, q_isbn_countries, q_isbn_printed, q_roman, q_year_check, q_url_check, q_doi_check, q_length_check, q_pattern_volume, q_pattern_pages, q_month_macro,
        q_pages_fix, q_names_fix, q_squeeze_space, q_delete_empty, q_remove_opt, q_field_case_map, q_keyword_upsert, q_tokenize, q_duplicate_keys, q_sorted_keys, q_like_search, q_error_count, q_parse_entries, q_prettyprint,
        q_lex, q_scribe, q_diagnostics,
    )
    return {f.__name__: f for f in plain} | generated.queries() | onefile.queries()


def oracle_sql() -> dict[str, str]:
    match = "FROM i JOIN " + _ranges_sql() + " ON substr(isbn, 1, length(low)) BETWEEN low AND high"
    return {
        "q_issn_check": _ISSN_SQL + "SELECT p_partkey, issn, list_sum(list_transform(range(1, 8), lambda k: CAST(substr(replace(issn, '-', ''), k, 1) AS BIGINT) * (k + 2))) % 11 = CASE substr(issn, 9, 1) WHEN 'X' THEN 10 ELSE CAST(substr(issn, 9, 1) AS BIGINT) END AS valid FROM i",
        "q_isbn10_check": _ISBN10_SQL + "SELECT o_orderkey, isbn, list_sum(list_transform(range(1, 11), lambda k: CASE substr(isbn, k, 1) WHEN 'X' THEN 10 ELSE CAST(substr(isbn, k, 1) AS BIGINT) END * k)) % 11 = 0 AS valid FROM i",
        "q_isbn13_check": """WITH k AS (SELECT 'customer' AS source, c_custkey AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier),
t AS (SELECT *, (CASE WHEN k % 9 = 0 THEN '977' ELSE '978' END) || lpad(CAST((k * 16807) % 1000000000 AS VARCHAR), 9, '0') AS twelve FROM k),
i AS (SELECT source, k, twelve || CAST((10 - (list_sum(list_transform(range(1, 13), lambda j: CAST(substr(twelve, j, 1) AS BIGINT) * CASE WHEN j % 2 = 1 THEN 1 ELSE 3 END)) + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) % 10) % 10 AS VARCHAR) AS isbn FROM t)
SELECT source, k, isbn, substr(isbn, 1, 3) IN ('978', '979') AND list_sum(list_transform(range(1, 14), lambda j: CAST(substr(isbn, j, 1) AS BIGINT) * CASE WHEN j % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0 AS valid FROM i""",
        "q_coden_check": _CODEN_SQL,
        "q_isbn_hyphenate": _ISBN10_SQL + f""", m AS (SELECT isbn, o_orderkey, min(ord) AS ord {match} GROUP BY ALL)
SELECT i.o_orderkey, i.isbn, coalesce(substr(i.isbn, 1, g) || '-' || substr(i.isbn, g + 1, length(low) - g) || '-' || substr(i.isbn, length(low) + 1, 9 - length(low)) || '-' || substr(i.isbn, 10, 1), i.isbn) AS hyphenated
FROM i LEFT JOIN m ON i.o_orderkey = m.o_orderkey LEFT JOIN {_ranges_sql()} ON r.ord = m.ord""",
        "q_isbn_range_join": _ISBN10_SQL + f"SELECT CAST(ord AS INT) AS ord, low, high, count(*) AS n_isbn {match} GROUP BY ALL",
        "q_isbn_countries": _NATION_RANGES_SQL + """, t AS (SELECT (o_orderkey % 30 + 600) || lpad(CAST((o_orderkey * 48271) % 1000000 AS VARCHAR), 6, '0') AS nine FROM orders)
SELECT coalesce("begin", '') AS "begin", coalesce(countries, '') AS countries, count(*) AS n FROM t LEFT JOIN r ON substr(nine, 1, length(low)) BETWEEN low AND high GROUP BY 1, 2""",
        "q_isbn_printed": _NATION_RANGES_SQL + """ SELECT ord, rpad("begin", 11, ' ') || chr(9) || rpad("end", 11, ' ') || CASE WHEN j = 0 THEN chr(9) || countries ELSE '' END AS line FROM r""",
        "q_roman": "SELECT p_partkey, CAST(p_size AS BIGINT) AS expected, CAST(p_size AS BIGINT) AS value FROM part",
        "q_year_check": """WITH y AS (SELECT o_orderkey, '"' || CASE o_orderkey % 5 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN 1454 WHEN 2 THEN 1455 WHEN 3 THEN 2099 ELSE 2100 END || CASE WHEN o_orderkey % 2 = 0 THEN ', 1999' ELSE '' END || '"' AS year FROM orders)
SELECT o_orderkey, year, CAST(len(list_filter(regexp_extract_all(year, '[0-9]+'), lambda v: CAST(v AS BIGINT) NOT BETWEEN 1455 AND 2099)) AS BIGINT) AS suspicious FROM y""",
        "q_url_check": """WITH v AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'gopher://host/' || page_id WHEN 2 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 3 THEN 'http://dx.doi.org/10.1000/' || page_id ELSE 'https://www.example.com/10.' || page_id END AS value FROM pages)
SELECT page_id, value, concat_ws(',', CASE WHEN value NOT LIKE '%://%' THEN 'url_protocol_missing' END,
  CASE WHEN value LIKE '%://%' AND NOT regexp_matches(split_part(value, '://', 1), '(ftp|http|https)$') THEN 'url_protocol_unexpected' END,
  CASE WHEN value LIKE '%://%' AND contains(lower(value), '//dx.doi.org/') THEN 'url_is_doi' END,
  CASE WHEN value LIKE '%://%' AND regexp_matches(lower(value), '[.](com|edu|net|org)/10[.]') THEN 'url_maybe_doi' END) AS codes FROM v""",
        "q_doi_check": "WITH v AS (SELECT p_partkey, '10.' || (p_partkey % 9000 + 1000) || CASE p_partkey % 7 WHEN 0 THEN '/a b' WHEN 1 THEN '/x,y' WHEN 2 THEN '/p;q' ELSE '/v' END || p_partkey AS doi FROM part) SELECT p_partkey, doi, regexp_matches(doi, '[ ,;]') AS separators FROM v",
        "q_length_check": "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 10000",
        "q_pattern_volume": _chosen_sql(VOLUMES, (1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 1, 0)),
        "q_pattern_pages": _chosen_sql(PAGES, (1, 2, 3, 4, 5, 7, 13, 0, 20, 0)),
        "q_month_macro": "SELECT lower(strftime(o_orderdate, '%b')) AS month, count(*) AS n FROM orders GROUP BY 1",
        "q_pages_fix": """SELECT '"' || l_linenumber || '--' || (l_linenumber + 10) || CASE WHEN l_orderkey % 4 = 3 THEN ', A-7' ELSE '' END || '"' AS pages, count(*) AS n FROM lineitem GROUP BY 1""",
        "q_names_fix": f"""WITH c AS (SELECT *, substr('{_LETTERS}', c_custkey % 26 + 1, 1) AS a, substr('{_LETTERS}', (c_custkey * 7) % 26 + 1, 1) AS b, substr('{_LETTERS}', (c_custkey * 3) % 26 + 1, 1) AS e FROM customer)
SELECT c_custkey, a || '. ' || b || '. Smith' || c_custkey || ' and Ann ' || e || '. Jones and ' || c_mktsegment || ' Lee' AS names FROM c""",
        "q_squeeze_space": r"SELECT doc_id, regexp_replace(text, '([ \t\n\x0B\f\r])[ \t\n\x0B\f\r]+', '\1', 'g') AS squeezed FROM documents",
        "q_delete_empty": f"""WITH {_named_sql(_OPTS)} SELECT * FROM n WHERE value <> '""'""",
        "q_remove_opt": f"""WITH {_named_sql(_OPTS)} SELECT n_nationkey, CASE WHEN starts_with(name, 'OPT') AND length(name) > 3 AND length(value) > 2 THEN substr(name, 4) ELSE name END AS name, value FROM n""",
        "q_field_case_map": f"""WITH {_named_sql(_RAW_NAMES)} SELECT n_nationkey, name AS raw, CASE lower(name) WHEN 'isbn-13' THEN 'ISBN-13' WHEN 'coden' THEN 'CODEN' WHEN 'issn' THEN 'ISSN' WHEN 'url' THEN 'URL' ELSE regexp_replace(lower(name), '^opt', 'OPT') END AS name FROM n""",
        "q_keyword_upsert": "SELECT lower(n_name) AS old_name, CASE WHEN n_nationkey % 4 = 0 THEN 'xx' || n_name ELSE n_name END AS new_name FROM nation WHERE n_nationkey % 8 <> 0",
        "q_tokenize": """WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[ ]+|\n|[^A-Za-z0-9 \n]+')) AS t FROM documents)
SELECT CASE WHEN regexp_full_match(t, '[A-Za-z]+') THEN 'ABBREV' WHEN regexp_full_match(t, '[0-9]+') THEN 'VALUE' WHEN regexp_full_match(t, '[ ]+') THEN 'SPACE' WHEN t = chr(10) THEN 'NEWLINE' ELSE 'LITERAL' END AS token_name, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM t GROUP BY 1""",
        "q_duplicate_keys": "SELECT lower(substr(p_name, 1, 6)) AS cite_key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
        "q_sorted_keys": "SELECT DISTINCT lower(substr(p_name, 1, 8)) AS cite_key FROM part ORDER BY 1",
        "q_like_search": "SELECT doc_id, lang, source FROM documents WHERE text LIKE '%token%' OR (text LIKE '%the%' AND text LIKE '%License%') ORDER BY 1",
        "q_error_count": f"WITH {_DIAG_SQL} SELECT 'warning' AS severity, code, count(*) AS n FROM d WHERE code = 'suspicious_year' OR y < 1800 GROUP BY ALL",
        "q_parse_entries": _PARSED_SQL,
        "q_prettyprint": _PRETTY_SQL,
        "q_lex": """WITH n AS (SELECT count(*) AS e, count(DISTINCT floor(p_partkey / 100)) AS f FROM part)
SELECT v.token_name, v.n FROM n, LATERAL (VALUES ('AT', e), ('ENTRY', e), ('LBRACE', e), ('KEY', e), ('FIELD', 6 * e), ('EQUALS', 6 * e), ('VALUE', 6 * e), ('COMMA', 7 * e), ('RBRACE', e), ('SPACE', 16 * e), ('NEWLINE', 9 * e - f)) AS v(token_name, n)""",
        "q_scribe": """SELECT 'S' || s_suppkey AS cite_key, CAST(seq AS BIGINT) AS seq, name, value FROM supplier,
LATERAL (VALUES (0, 'key', '"' || s_name || '"'), (1, 'title', '"' || s_name || '"'), (2, 'year', '"' || (s_suppkey % 90 + 1900) || '"')) AS v(seq, name, value)""",
        "q_diagnostics": f"""WITH {_DIAG_SQL} SELECT file, 'P' || p_partkey AS cite_key, 'warning' AS severity, code, '%% ' || file || ':0:' || head || ' ``year = "' || y || '"''''.' AS message FROM d WHERE code = 'suspicious_year' OR y < 1800""",
    } | generated.oracle_sql() | onefile.oracle_sql()
