"""Queries on bibliographies made from the provided tables: entries, checks, configuration and fixes whose results SQL
computes from the same keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import checking, fixes, identifiers, text
from scholia.operators import bibliography as B
from scholia.options import Options, resolve
from scholia.sources import config as C

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: The columns that texts are made from, of tables whose rows are dealt out before.
COLUMNS = {"customer": ("c_custkey",), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_retailprice"), "orders": ("o_orderkey", "o_orderdate")}


def _spread(spark, d: str, name: str) -> DataFrame:
    """A table whose rows become texts: its keys lie in one file of a few MB, the work is done by all tasks."""
    return B.spread(_t(spark, d, name).select(*COLUMNS[name]), COLUMNS[name][0])


def _values(rows: DataFrame, key: str, make, schema: str = "string") -> DataFrame:
    """rows of (key, value) with a column made from each value in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([make(v) for v in b.column(1).to_pylist()])], [key, "value", "result"])

    return rows.select(key, "value").mapInArrow(run, f"{key} bigint, value string, result {schema}")


# fixes: templates in which @a, @A and @n stand for a letter, a capital and the number of the key

#: field, options, and pairs of given and fixed values.
TEMPLATES = {
    "q_accent_fix": ("author", Options(fix_accents=True), (("Erd\\H @as@n", "Erd{\\H{@a}}s@n"), ("Ren\\'@a @n", "Ren{\\'@a} @n"), ('\\"{@A}lie', '{\\"@A}lie'), ("Stra\\ss @a@n", "Stra{\\ss}@a@n"), ("{\\'@a}", "{\\'@a}"))),
    "q_brace_fix": ("author", Options(fix_braces=True), (("{@A}x{C}e{L}e{N}t@n", "{@AxCeLeNt@n}"), ("non{@A}nglish", "{non@Anglish}"), ("{@A}{B} @n", "{@AB} @n"), ("{ }@a@n", "{ }@a@n"), ("{\\em @a}", "{\\em @a}"))),
    "q_font_fix": ("title", Options(fix_font_changes=True), (("in {\\it @Aicty@n}", "in {{\\it @Aicty@n}}"), ("{{\\bf @a}} @n", "{{\\bf @a}} @n"), ("plain @n", "plain @n"), ("{\\em @a} b@n", "{{\\em @a}} b@n"), ("{@A}", "{@A}"))),
    "q_math_fix": ("note", Options(fix_math=True), (("$@a=f   ( @a+@n/d   )$", "$ @a = f (@a + @n / d) $"), ("$@a:@n:c$", "$ @a : @n : c $"), ("$@A$ @n", "$@A$ @n"), ("$_@n$ @a", "$_@n$ @a"), ("$@a=f(@n,b,c;x)$", "$ @a = f(@n, b, c; x) $"))),
    "q_name_order": ("author", Options(), (("Jones@n, Jr., @Ailliam", "@Ailliam {Jones@n, Jr.}"), ("von B@n, @Audwig", "@Audwig von B@n"), ("Smith@n, @A.K.", "@A. K. Smith@n"), ("Charles XIII, @Aing", "@Aing {Charles XIII}"), ("{Steele@n Jr.}, Guy @A.", "Guy @A. {Steele@n Jr.}"))),
    "q_title_fix": ("title", Options(), (("$@A$$^3$ @n", "{$@A^3$} @n"), ("Signal {@A} proteins @n", "Signal {@A} proteins @n"), ("The @a crystal", "The @a crystal"), ("On {\\em @A. coli} @n", "On {{\\em @A. coli}} @n"), ("Erd\\H @as @n", "Erd{\\H{@a}}s @n"))),
}


def _filled(template: Column, k: Column) -> Column:
    capital = F.substring(F.lit(LETTERS), (k % 26 + 1).cast("int"), F.lit(1))
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), p[1]), (("@A", capital), ("@a", F.lower(capital)), ("@n", k.cast("string"))), template)


def _fixed(name: str):
    field, options, pairs = TEMPLATES[name]

    def query(spark, d):
        k = F.col("c_custkey")
        template = F.element_at(F.array(*(F.lit(f'"{g}"') for g, _ in pairs)), (k % 5 + 1).cast("int"))
        rows = _spread(spark, d, "customer").select(k.cast("bigint").alias("c_custkey"), _filled(template, k).alias("value"))
        if field == "author" and not fixes.names_need_tex(options):
            return rows.withColumn("result", text.quoted_names(F.col("value")))
        return _values(rows, "c_custkey", lambda v: fixes.fix(field, v, options, lambda *_: None))

    query.__name__ = name
    return query


def _fixed_sql(name: str) -> str:
    q = lambda s: "'\"" + s.replace("'", "''") + "\"'"
    fill = lambda s: f"replace(replace(replace({s}, '@A', l), '@a', lower(l)), '@n', CAST(c_custkey AS VARCHAR))"
    rows = ", ".join(f"({k}, {q(a)}, {q(b)})" for k, (a, b) in enumerate(TEMPLATES[name][2]))
    return f"WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS c_custkey, substr('{LETTERS}', c_custkey % 26 + 1, 1) AS l FROM customer) SELECT c_custkey, {fill('v.given')} AS value, {fill('v.fixed')} AS result FROM c JOIN (VALUES {rows}) AS v(k, given, fixed) ON c_custkey % 5 = v.k"


# checks by the parser


def _entries(rows: DataFrame, key: Column, fields: Column) -> DataFrame:
    """A file for each row: an entry with that citation key and these fields."""
    return rows.select(F.format_string("%s.bib", key).alias("file"), F.concat(F.lit("@Book{"), key, F.lit(",\n"), fields, F.lit("\n}\n")).alias("text"))


def _codes(texts: DataFrame, options: Options | None = None, **config) -> DataFrame:
    """(cite_key, code, n, message) of all diagnostics, equal ones counted."""
    return B.diagnostics(texts, options, **config).groupBy("cite_key", "code", "message").agg(F.count("*").alias("n"))


def _isbn13(k: Column) -> Column:
    twelve = F.concat(F.lit("978"), F.lpad((k * 16807 % 10**9).cast("string"), 9, "0"))
    total = sum(F.substring(twelve, j, 1).cast("int") * (1 if j % 2 else 3) for j in range(1, 13))
    return F.concat(twelve, ((10 - (total + F.when(k % 4 == 0, 1).otherwise(0)) % 10) % 10).cast("string"))


_ISBN13_SQL = """t AS (SELECT CAST(s_suppkey AS BIGINT) AS k, '978' || lpad(CAST((s_suppkey * 16807) % 1000000000 AS VARCHAR), 9, '0') AS twelve FROM supplier),
i AS (SELECT k, twelve || CAST((10 - (list_sum(list_transform(range(1, 13), lambda j: CAST(substr(twelve, j, 1) AS BIGINT) * CASE WHEN j % 2 = 1 THEN 1 ELSE 3 END)) + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) % 10) % 10 AS VARCHAR) AS isbn FROM t)"""


def q_isbn13_hyphenate(spark, d):
    """ISBN-13 values in a list with comments, found, hyphenated and checked by the parser."""
    k = F.col("s_suppkey")
    texts = _entries(_spread(spark, d, "supplier"), F.concat(F.lit("S"), k.cast("string")), F.concat(F.lit('ISBN-13 = "'), _isbn13(k), F.lit(' (no. '), k.cast("string"), F.lit(')"')))
    found = B.fields(B.entries(texts)).select("cite_key", "value")
    bad = B.diagnostics(texts).groupBy("cite_key").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    return found.join(bad, "cite_key", "left").select("cite_key", "value", F.coalesce("codes", F.lit("")).alias("codes"))


def _ranges_sql() -> str:
    return "(VALUES " + ", ".join(f"({k}, '{b.replace('-', '')}', '{e.replace('-', '')}', {len(b.split('-')[0])})" for k, (b, e) in enumerate(identifiers.ISBN_RANGES)) + ") AS r(ord, low, high, g)"


_ISBN13_HYPHENATE_SQL = f"""WITH {_ISBN13_SQL}, x AS (SELECT k, isbn, substr(isbn, 4) AS ten FROM i),
m AS (SELECT k, arg_min(struct_pack(g := g, n := length(low)), ord) AS r FROM x JOIN {_ranges_sql()} ON substr(ten, 1, length(low)) BETWEEN low AND high GROUP BY k)
SELECT 'S' || x.k AS cite_key, '"' || CASE WHEN r IS NULL THEN isbn ELSE '978-' || substr(ten, 1, r.g) || '-' || substr(ten, r.g + 1, r.n - r.g) || '-' || substr(ten, r.n + 1, 9 - r.n) || '-' || substr(ten, 10, 1) END || ' (no. ' || x.k || ')"' AS value,
CASE WHEN x.k % 4 = 0 THEN 'isbn13_checksum' ELSE '' END AS codes FROM x LEFT JOIN m ON x.k = m.k"""


def q_issn_list(spark, d):
    """ISSN lists: whole, short and overlong elements, and the length rule of ISSN-L."""
    k = F.col("p_partkey")
    seven = F.lpad((k * 7919 % 10**7).cast("string"), 7, "0")
    total = sum(F.substring(seven, j, 1).cast("int") * (j + 2) for j in range(1, 8))
    issn = F.concat(F.substring(seven, 1, 4), F.lit("-"), F.substring(seven, 5, 3), F.substring(F.lit("0123456789X"), ((total + (k % 3 == 0).cast("int")) % 11 + 1).cast("int"), F.lit(1)))
    name = F.when(k % 2 == 0, "ISSN").otherwise("ISSN-L")
    value = F.concat(issn, F.when(k % 5 == 0, F.concat(F.lit(", "), F.substring(seven, 1, 5))).otherwise(""))
    texts = _entries(_spread(spark, d, "part"), F.concat(F.lit("P"), k.cast("string")), F.concat(name, F.lit(' = "'), value, F.lit('"')))
    return _codes(texts)


_ISSN_LIST_SQL = """WITH s AS (SELECT p_partkey AS k, lpad(CAST((p_partkey * 7919) % 10000000 AS VARCHAR), 7, '0') AS seven FROM part),
c AS (SELECT *, list_sum(list_transform(range(1, 8), lambda j: CAST(substr(seven, j, 1) AS BIGINT) * (j + 2))) AS total FROM s),
i AS (SELECT k, seven, substr(seven, 1, 4) || '-' || substr(seven, 5, 3) || substr('0123456789X', CAST((total + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) % 11 + 1 AS BIGINT), 1) AS issn FROM c),
v AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'ISSN' ELSE 'ISSN-L' END AS name, issn || CASE WHEN k % 5 = 0 THEN ', ' || substr(seven, 1, 5) ELSE '' END AS value FROM i)
SELECT 'P' || k AS cite_key, 'issn_checksum' AS code, 'Invalid checksum for ISSN ' || issn || ' in ``' || name || ' = "' || value || '"''''' AS message, 1 AS n FROM v WHERE k % 3 = 0
UNION ALL SELECT 'P' || k, 'issn_checksum', 'Invalid checksum for ISSN ' || substr(seven, 1, 4) || '-' || substr(seven, 5, 1) || '??? in ``' || name || ' = "' || value || '"''''', 1 FROM v WHERE k % 5 = 0
UNION ALL SELECT 'P' || k, 'issn_l_length', 'Unexpected ISSN-L field length in ``"' || value || '"''''', 1 FROM v WHERE k % 2 = 1 AND length(value) <> 9"""


def q_month_check(spark, d):
    """Months: a name that becomes a macro, a macro with a day, and a word that is none."""
    k, when = F.col("o_orderkey"), F.col("o_orderdate")
    value = F.when(k % 3 == 0, F.concat(F.lit('"'), F.date_format(when, "MMMM"), F.lit('"'))).when(k % 3 == 1, F.concat(F.lower(F.date_format(when, "MMM")), F.lit(' # " '), F.dayofmonth(when).cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('"Term '), F.year(when).cast("string"), F.lit('"')))
    texts = _entries(_spread(spark, d, "orders"), F.concat(F.lit("O"), k.cast("string")), F.concat(F.lit("month = "), value))
    return B.diagnostics(texts).groupBy("code", "value", "message").agg(F.count("*").alias("n"))


_MONTH_CHECK_SQL = """WITH v AS (SELECT '"Term ' || year(o_orderdate) || '"' AS value FROM orders WHERE o_orderkey % 3 = 2)
SELECT 'unexpected_value' AS code, value, 'Unexpected value in ``month = ' || value || '''''' AS message, count(*) AS n FROM v GROUP BY ALL"""


def q_field_patterns(spark, d):
    """Chapters, numbers and prices by the built-in patterns, one of which has a message of its own."""
    k = F.col("p_partkey").cast("string")
    price = F.format_string("%d.%02d", F.floor(F.col("p_retailprice")).cast("long"), F.col("p_partkey") % 100)
    fields = F.concat(
        F.lit('chapter = "'), k, F.when(F.col("p_partkey") % 2 == 0, ".").otherwise("/"), k, F.lit('",\nnumber = "'), k, F.when(F.col("p_partkey") % 3 == 0, "<").otherwise("A"),
        F.lit('",\nprice = "'), F.when(F.col("p_partkey") % 5 == 0, "").otherwise("US"), price, F.lit('"'),
    )
    return _codes(_entries(_spread(spark, d, "part"), F.concat(F.lit("P"), k), fields))


_FIELD_PATTERNS_SQL = """WITH p AS (SELECT p_partkey AS k, CAST(floor(p_retailprice) AS BIGINT) || '.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS price FROM part)
SELECT 'P' || k AS cite_key, 'unexpected_value' AS code, 'Unexpected value in ``chapter = "' || k || '/' || k || '"''''' AS message, 1 AS n FROM p WHERE k % 2 = 1
UNION ALL SELECT 'P' || k, 'unexpected_value', 'Unexpected value in ``number = "' || k || '<"''''', 1 FROM p WHERE k % 3 = 0
UNION ALL SELECT 'P' || k, 'user_message', 'Put country prefix on price "' || price || '"', 1 FROM p WHERE k % 5 = 0"""


def q_key_check(spark, d):
    """Citation keys against patterns of an init file that are named like the keys."""
    nations = _t(spark, d, "nation")
    config = C.apply_init(C.Config(), 'n3 = "a"\nn5 : "ad"\nn7 = "dd" "no"')
    k = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    return _codes(_entries(nations, k, F.concat(F.lit('note = "'), F.col("n_name"), F.lit('"'))), **config.parser_args())


_KEY_CHECK_SQL = "SELECT 'N' || n_nationkey AS cite_key, 'unexpected_key' AS code, 'Unexpected citation key ``N' || n_nationkey || '''''' AS message, 1 AS n FROM nation WHERE n_nationkey IN (3, 7)"


def q_expression_patterns(spark, d):
    """Volumes and numbers by regular expressions of an init file, one with a message, beside a pattern of letters."""
    config = C.apply_init(C.Config(), r'''volume = ""
volume ~ "^\"[0-9]+\\(/[0-9]+\\)?\"$"
volume ~ "[A-C]" "letters in %v"
number = ""
number = "\"D\""
number ~ "(0)"''')
    k = F.col("p_partkey")
    volume = F.concat(k.cast("string"), F.when(k % 3 == 0, F.concat(F.lit("/"), k.cast("string"))).when(k % 3 == 1, F.substring(F.lit(LETTERS), (k % 26 + 1).cast("int"), F.lit(1))).otherwise(""))
    number = F.concat(k.cast("string"), F.when(k % 2 == 0, F.concat(F.lit("("), (k % 10).cast("string"), F.lit(")"))).otherwise(""))
    fields = F.concat(F.lit('volume = "'), volume, F.lit('",\nnumber = "'), number, F.lit('"'))
    return _codes(_entries(_spread(spark, d, "part"), F.concat(F.lit("P"), k.cast("string")), fields), **config.parser_args())


_EXPRESSION_PATTERNS_SQL = f"""WITH v AS (SELECT p_partkey AS k, substr('{LETTERS}', p_partkey % 26 + 1, 1) AS l FROM part)
SELECT 'P' || k AS cite_key, 'user_message' AS code, 'letters in "' || k || l || '"' AS message, 1 AS n FROM v WHERE k % 3 = 1 AND l IN ('A', 'B', 'C')
UNION ALL SELECT 'P' || k, 'unexpected_value', 'Unexpected value in ``volume = "' || k || l || '"''''', 1 FROM v WHERE k % 3 = 1 AND l NOT IN ('A', 'B', 'C')
UNION ALL SELECT 'P' || k, 'unexpected_value', 'Unexpected value in ``number = "' || k || '(' || (k % 10) || ')"''''', 1 FROM v WHERE k % 2 = 0 AND k % 10 <> 0"""


# text, values and errors by the parser


def q_passthrough(spark, d):
    """Text between entries, @Include, @Preamble and @String: what kind each is, and its body or value. Comments are no rows."""
    k, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    text = F.concat(F.lit("% about "), name, F.lit("\n@include{file"), k, F.lit("}\n\nfree text "), k, F.lit('\n\n@preamble{"a" # "'), name, F.lit('"}\n@string(n'), k, F.lit(" = {"), name, F.lit("})\n"))
    rows = B.entries(_spread(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("file"), text.alias("text")))
    value = F.when(F.col("kind") == "string", F.concat(F.col("fields")[0]["name"], F.lit("="), F.col("fields")[0]["value"])).otherwise(F.trim(F.regexp_replace("body", "\n", " ")))
    return rows.select("file", "kind", "entry_name", value.alias("value")).filter("value <> ''")


_PASSTHROUGH_SQL = """SELECT 's' || s_suppkey AS file, v.kind, v.entry_name, v.value FROM supplier, LATERAL (VALUES ('include', 'Include', 'file' || s_suppkey),
('other', '', 'free text ' || s_suppkey), ('preamble', 'Preamble', '"a" # "' || s_name || '"'), ('string', 'String', 'n' || s_suppkey || '="' || s_name || '"')) AS v(kind, entry_name, value)"""


def q_complex_value(spark, d):
    """Values of several parts, with blanks around them that are trimmed, as parts and as a whole."""
    k = F.col("s_suppkey").cast("string")
    texts = _entries(_spread(spark, d, "supplier"), F.concat(F.lit("S"), k), F.concat(F.lit('publisher = pub'), k, F.lit('#"  and"#{ {X} '), F.col("s_name"), F.lit(' }#\n'), k))
    f = B.fields(B.entries(texts))
    return f.select("cite_key", "value", F.array_join(F.transform("parts", lambda p: F.concat(p["type"], F.lit("="), p["text"])), "|").alias("parts"))


_COMPLEX_VALUE_SQL = """WITH v AS (SELECT s_suppkey AS k, 'pub' || s_suppkey AS a, '" and"' AS b, '" {X} ' || s_name || ' "' AS c, '"' || s_suppkey || '"' AS e FROM supplier)
SELECT 'S' || k AS cite_key, a || ' # ' || b || ' # ' || c || ' # ' || e AS value, 'abbrev=' || a || '|quoted=' || b || '|braced=' || c || '|digits=' || e AS parts FROM v"""


def q_error_resync(spark, d):
    """Entries broken in four ways: the error, its line, and that the next entry is read again."""
    k = F.col("s_suppkey")
    s = k.cast("string")
    broken = F.when(k % 4 == 0, '@Book{x, title "no equals"}').when(k % 4 == 1, '@Book{x, title = "a" year = 1}').when(k % 4 == 2, "@9{x}").otherwise("@Book x")
    texts = _spread(spark, d, "supplier").select(F.concat(F.lit("s"), s).alias("file"), F.concat(F.repeat(F.lit("\n"), (k % 7).cast("int")), broken, F.lit("\n@Misc{M"), s, F.lit(", note = 5}\n")).alias("text"))
    errors = B.diagnostics(texts).filter("severity = 'error'").select("file", "code", "line")
    after = B.entries(texts).filter("kind = 'entry'").select("file", "cite_key")
    return errors.join(after, "file")


_ERROR_RESYNC_SQL = """SELECT 's' || s_suppkey AS file, CASE s_suppkey % 4 WHEN 0 THEN 'expected_equals' WHEN 1 THEN 'expected_comma' WHEN 2 THEN 'entry_name' ELSE 'expected_open' END AS code,
CAST(s_suppkey % 7 + 1 AS BIGINT) AS line, 'M' || s_suppkey AS cite_key FROM supplier"""


def q_token_text(spark, d):
    """The texts of tokens, in order, and where each line directive stands."""
    k = F.col("n_nationkey").cast("string")
    texts = _entries(_t(spark, d, "nation"), F.concat(F.lit("N"), k), F.concat(F.lit('note = "'), F.col("n_name"), F.lit('" # n'), k))
    return B.tokens(texts).filter("token_name NOT IN ('SPACE', 'NEWLINE')").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_seq", "token_name", "text"))), lambda t: F.concat(t["token_name"], F.lit(":"), t["text"])), " ").alias("tokens"))


_TOKEN_TEXT_SQL = """SELECT 'N' || n_nationkey || '.bib' AS file, 'AT:@ ENTRY:Book LBRACE:{ KEY:N' || n_nationkey || ' COMMA:, FIELD:note EQUALS:= VALUE:"' || n_name || '" SHARP:# ABBREV:n' || n_nationkey || ' COMMA:, RBRACE:}' AS tokens FROM nation"""


def q_token_wrap(spark, d):
    """Long value tokens in a stream of 40 columns."""
    k = F.col("n_nationkey").cast("string")
    texts = _entries(_t(spark, d, "nation"), F.concat(F.lit("N"), k), F.concat(F.lit('note = "'), F.repeat(F.concat(F.col("n_name"), F.lit(" ")), 7), k, F.lit('"')))
    lines = B.token_text(texts, Options(max_width=40))
    return lines.select("file", F.regexp_extract("text", "(?s)\n(19\tVALUE\t.*?)\n(?=[0-9]+\t|#)", 1).alias("line"))


_TOKEN_WRAP_SQL = r"""WITH l AS (SELECT 'N' || n_nationkey || '.bib' AS file, '19' || chr(9) || 'VALUE' || chr(9) || '"\"' || repeat(n_name || ' ', 7) || n_nationkey || '\""' AS line FROM nation)
SELECT file, array_to_string(list_transform(range(0, (length(line) + 38) // 39), lambda i: substr(line, CAST(39 * i + 1 AS BIGINT), 39)), '\' || chr(10)) AS line FROM l"""


def q_merged(spark, d):
    """Text and messages in one stream: a year that is none stands after its two messages."""
    k = F.col("n_nationkey")
    texts = _t(spark, d, "nation").select(F.concat(F.lit("n"), k.cast("string")).alias("file"), F.concat(F.lit("@misc{N"), k.cast("string"), F.lit(", note = {"), F.col("n_name"), F.lit("},\nyear = "), (k + 1440).cast("string"), F.lit("}\n")).alias("text"))
    return B.merged(texts)


_MERGED_SQL = """WITH n AS (SELECT n_nationkey AS k, 'n' || n_nationkey AS file, n_nationkey + 1440 AS y, n_name FROM nation),
l AS (SELECT file, v.o, v.text FROM n, LATERAL (VALUES (1, '@Misc{N' || k || ',', true), (2, '  note =         "' || n_name || '",', true), (3, '%% ' || file || ':2:Unexpected value in ``year = "' || y || '"''''.', true),
(4, '%% ' || file || ':2:Suspicious year in ``year = "' || y || '"''''.', y < 1455), (5, '  year =         "' || y || '",', true), (6, '}', true)) AS v(o, text, there) WHERE v.there)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY o) AS line_no, text FROM l"""


# configuration


def _configured(rows: DataFrame, key: str, make, columns: str) -> DataFrame:
    """rows of (key, text) with the rows that each text gives."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(k, *r) for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in make(text)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*got, strict=True)], [key, *names]) if got else pa.RecordBatch.from_arrays([pa.array([], pa.string())] * (1 + len(names)), [key, *names])

    return rows.select(F.col(key).cast("string").alias(key), "text").mapInArrow(run, f"{key} string, {columns}")


def q_init_file(spark, d):
    """An init file for each supplier: comments, joined lines, escapes, options, patterns that are added, changed and cleared."""
    k, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    text = F.concat(F.lit('% comment\nmine = "D\\x41" "first"\nmine : "'), name, F.lit('" "\\"'), k, F.lit('\\""\n-max-width \\\n'), k, F.lit('\nmine = "D\\x41" \\\n"again" % end\n'), F.when(F.col("s_suppkey") % 2 == 0, 'number = ""\n').otherwise(""))

    def rows(text: str) -> list[tuple[str, str, str]]:
        c = C.apply_init(C.Config(), text)
        return [*((f"mine{j}", p, m or "") for j, (p, m) in enumerate(c.patterns["mine"])), ("width", str(c.options.max_width), ""), ("numbers", "some" if c.patterns["number"] else "none", "")]

    return _configured(_spread(spark, d, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", rows, "item string, value string, message string")


_INIT_FILE_SQL = """SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, v.item, v.value, v.message FROM supplier, LATERAL (VALUES ('mine0', 'Dx41', 'again'), ('mine1', s_name, '"' || s_suppkey || '"'),
('width', CAST(s_suppkey AS VARCHAR), ''), ('numbers', CASE WHEN s_suppkey % 2 = 0 THEN 'none' ELSE 'some' END, '')) AS v(item, value, message)"""


def q_keyword_file(spark, d):
    """A keyword file for each supplier: new names, replaced and deleted ones, and the table as it is printed."""
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("mine"), k, F.lit(" MINE-"), k, F.lit("\nISSN issn% old form\n-CODEN\n"))

    def rows(text: str) -> list[tuple[str]]:
        return [(line.strip(),) for line in C.keyword_lines(C.apply_keywords(C.Config(), text)) if line.split()[0] in ("issn", "coden", "url") or line.startswith("mine")]

    return _configured(_spread(spark, d, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", rows, "line string")


_KEYWORD_FILE_SQL = """SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, trim(rpad(v.a, 31, ' ') || chr(9) || v.b) AS line FROM supplier, LATERAL (VALUES ('mine' || s_suppkey, 'MINE-' || s_suppkey), ('issn', 'issn'), ('url', 'URL')) AS v(a, b)"""


def q_isbn_file(spark, d):
    """A range file for each supplier: a new range, its printed row, and a number that it splits."""
    k = F.col("s_suppkey")
    low = F.lpad((k % 10000).cast("string"), 4, "0")
    text = F.concat(F.lit("-0-00\n6-"), low, F.lit(" 6-"), low, F.lit(" Land "), k.cast("string"), F.lit(" % new\n"))

    def rows(text: str) -> list[tuple[str, str]]:
        c = C.apply_isbn(C.Config(), text)
        begin = c.isbn_ranges[-1][0]
        return [(C.isbn_lines(c)[-1], checking.hyphenate(begin.replace("-", "") + "12345", c.isbn_ranges[-1:]) or "")]

    return _configured(_spread(spark, d, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", rows, "line string, hyphenated string")


_ISBN_FILE_SQL = """WITH s AS (SELECT s_suppkey AS k, '6-' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') AS r FROM supplier)
SELECT CAST(k AS VARCHAR) AS s_suppkey, rpad(r, 11, ' ') || chr(9) || rpad(r, 11, ' ') || chr(9) || 'Land ' || k AS line, r || '-1234-5' AS hyphenated FROM s"""


def q_options(spark, d):
    """Options cut short, denied, in capitals and with a word."""
    k = F.col("s_suppkey")
    text = F.concat(F.when(k % 2 == 0, "-no-fix-n").otherwise("--FIX-NAMES"), F.when(k % 3 == 0, " -scr").otherwise(""), F.lit(" -max "), k.cast("string"), F.when(k % 5 == 0, " -q").otherwise(""), F.lit(" file"), k.cast("string"))

    def rows(text: str) -> list[tuple[bool, bool, bool, int, str]]:
        o, _, files = resolve(text.split())
        return [(o.fix_names, o.scribe, o.warnings, o.width, ",".join(files))]

    return _configured(_spread(spark, d, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", rows, "names boolean, scribe boolean, warnings boolean, width bigint, files string")


_OPTIONS_SQL = "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_suppkey % 2 <> 0 AS names, s_suppkey % 3 = 0 AS scribe, s_suppkey % 5 <> 0 AS warnings, CASE WHEN s_suppkey = 0 THEN 1152921504606846976 ELSE CAST(s_suppkey AS BIGINT) END AS width, 'file' || s_suppkey AS files FROM supplier"

_PLAIN = (
    (q_isbn13_hyphenate, _ISBN13_HYPHENATE_SQL), (q_issn_list, _ISSN_LIST_SQL), (q_month_check, _MONTH_CHECK_SQL), (q_field_patterns, _FIELD_PATTERNS_SQL), (q_key_check, _KEY_CHECK_SQL), (q_expression_patterns, _EXPRESSION_PATTERNS_SQL), (q_passthrough, _PASSTHROUGH_SQL),
    (q_complex_value, _COMPLEX_VALUE_SQL), (q_error_resync, _ERROR_RESYNC_SQL), (q_token_text, _TOKEN_TEXT_SQL), (q_token_wrap, _TOKEN_WRAP_SQL), (q_merged, _MERGED_SQL), (q_init_file, _INIT_FILE_SQL), (q_keyword_file, _KEYWORD_FILE_SQL), (q_isbn_file, _ISBN_FILE_SQL),
    (q_options, _OPTIONS_SQL),
)


def queries() -> dict:
    return {f.__name__: f for f, _ in _PLAIN} | {n: _fixed(n) for n in TEMPLATES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: q for f, q in _PLAIN} | {n: _fixed_sql(n) for n in TEMPLATES}
