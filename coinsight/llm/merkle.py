"""Document fingerprints as Merkle trees, in DataFrame operations only.

A text is cut into sections (at empty lines), paragraphs (at line ends) and
blocks of eight words. Paragraph nodes digest their exact text, section nodes
their paragraphs, the root all sections. A fingerprint lists root, sections,
paragraphs and blocks, so equal roots mean equal texts, and where two trees
part shows which sections, paragraphs and blocks were edited. Likeness is the
share of blocks in common, 1 for equal roots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
BLOCK = rf"[^\x20\x09-\x0D]+(?:{SPACE}+[^\x20\x09-\x0D]+){{0,7}}"
BUCKET_ROWS = 1000  # about so many rows of neighbouring ids are ordered together
MAX_BUCKETS = 4096  # bounds what the driver holds of the order


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of a text column.

    root;sections;paragraphs;blocks. Each section is its node and number of
    paragraphs, each paragraph its node and number of blocks.
    """
    block = BLOCK.replace("\\", "\\\\")
    df = df.withColumn("__p", F.expr(f"transform(split({text}, '\\n\\n'), s -> split(s, '\\n'))"))
    df = df.withColumn("__n", F.expr("transform(__p, s -> transform(s, p -> md5(p)))"))
    df = df.withColumn("__s", F.expr("transform(__n, s -> md5(array_join(s, '')))"))
    df = df.withColumn("__b", F.expr(f"transform(flatten(__p), p -> transform(regexp_extract_all(p, '{block}', 0), b -> left(md5(b), 8)))"))
    sections = F.expr("array_join(zip_with(__s, __n, (d, n) -> concat(left(d, 8), ':', size(n))), ',')")
    paragraphs = F.expr("array_join(zip_with(flatten(__n), __b, (d, b) -> concat(left(d, 8), ':', size(b))), ',')")
    root = F.expr("md5(array_join(__s, ''))")
    return df.withColumn(name, F.concat_ws(";", root, sections, paragraphs, F.expr("array_join(flatten(__b), ',')"))).drop("__p", "__n", "__s", "__b")


def likeness(a: str, b: str) -> Column:
    """How alike two fingerprint columns are, 0 to 1."""
    blocks = [F.array_distinct(F.filter(F.split(F.element_at(F.split(c, ";"), 4), ","), lambda x: x != "")) for c in (a, b)]
    both = F.size(F.array_intersect(*blocks))
    share = F.try_divide(2.0 * both, (F.size(blocks[0]) + F.size(blocks[1])).cast("double"))
    return F.when(F.substring_index(a, ";", 1) == F.substring_index(b, ";", 1), 1.0).otherwise(F.coalesce(share, F.lit(0.0)))


def _bucket(bounds: list[int]) -> Column:
    """How many bounds are at most the key, by halving steps."""
    if not bounds:
        return F.lit(0)
    steps, k = [], 1
    while k <= len(bounds):
        steps.insert(0, k)
        k *= 2
    array = f"array({', '.join(f'{b}L' for b in bounds)})"
    return F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (i, s) -> if(i + s <= {len(bounds)} and element_at({array}, least(i + s, {len(bounds)})) <= __k, i + s, i))")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (doc_id, text and others) with next_<column> of the row after it.

    Rows go by descending doc_id, equal ids by a hash of the text, null ids
    last; after the last row comes the first. Ranges of ids are ordered apart:
    each range also gets the first row of the range that follows, so no row
    waits for a global order and each text is shuffled once.
    """
    least = -(1 << 62)
    docs = docs.withColumn("__k", F.coalesce("doc_id", F.lit(least))).withColumn("__h", F.xxhash64("text"))
    n = docs.select("__k").count()
    parts = max(1, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)))
    bounds = []
    if parts > 1:
        at = docs.agg(F.percentile_approx("__k", [k / parts for k in range(1, parts)], 100_000)).first()[0]
        bounds = sorted(set(at))
    docs = docs.withColumn("__r", _bucket(bounds))
    tops = sorted((tuple(r) for r in docs.groupBy("__r").agg(F.max("__k").alias("k")).collect()), reverse=True)
    # At most MAX_BUCKETS rows: each range with the first row of the next one.
    after = [(tops[i - 1][0], k) for i, (_, k) in enumerate(tops)]
    spark = docs.sparkSession
    ghosts = spark.createDataFrame(after, "__r int, __k long") if after else spark.createDataFrame([], "__r int, __k long")
    lent = docs.drop("__r").join(F.broadcast(ghosts), "__k").select(*docs.columns, F.lit(1).alias("__g"))
    from pyspark.sql import Window

    w = Window.partitionBy("__r").orderBy("__g", F.desc("__k"), "__h")
    rows = docs.withColumn("__g", F.lit(0)).unionByName(lent)
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(w))
    return rows.filter("__g = 0").drop("__k", "__h", "__r", "__g")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited forms, and how alike they are.

    A null text counts as empty; empty texts have one empty section and are
    alike. The edited text is the text with the last floor(n / 2) code points
    replaced by the first as many of the next document. One row per input row,
    repeated ones too; rows of one id follow a hash of their text, rows of one
    id and text are equal in any order. Long texts are taken whole, an empty
    table gives no rows, other columns are left out.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(docs, "text", "fingerprint"), ["text", "fingerprint"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - n_chars div 2)), substring(next_text, 1, int(n_chars div 2)))"))
    rows = with_fingerprint(rows.drop("text", "next_text"), "edited", "edited_fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def changed_sections(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with the numbers of sections and paragraphs of ``a`` missing in ``b``.

    Only branches that differ are looked into: with equal roots both lists are
    empty.
    """
    level = lambda c, k: f"transform(split(split({c}, ';')[{k}], ','), x -> split(x, ':')[0])"
    out = df
    for name, k in (("changed_sections", 1), ("changed_paragraphs", 2)):
        numbered = f"transform({level(a, k)}, (x, i) -> if(array_contains({level(b, k)}, x), null, i))"
        out = out.withColumn(name, F.expr(f"if(substring_index({a}, ';', 1) = substring_index({b}, ';', 1), cast(array() as array<int>), array_compact({numbered}))"))
    return out


def _sql_fingerprint(text: str) -> str:
    block = BLOCK
    p = f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: string_split(s, chr(10)))"
    n = f"list_transform({p}, lambda s: list_transform(s, lambda p: md5(p)))"
    s = f"list_transform({n}, lambda s: md5(array_to_string(s, '')))"
    blocks = f"list_transform(flatten({p}), lambda p: list_transform(regexp_extract_all(p, '{block}'), lambda b: md5(b)[1:8]))"
    sections = f"array_to_string(list_transform({n}, lambda s: md5(array_to_string(s, ''))[1:8] || ':' || len(s)), ',')"
    paragraphs = f"array_to_string(list_transform(flatten({p}), lambda p: md5(p)[1:8] || ':' || len(regexp_extract_all(p, '{block}'))), ',')"
    return f"concat_ws(';', md5(array_to_string({s}, '')), {sections}, {paragraphs}, array_to_string(flatten({blocks}), ','))"


def _sql_likeness(a: str, b: str) -> str:
    x, y = (f"list_distinct(list_filter(string_split(split_part({c}, ';', 4), ','), lambda x: x <> ''))" for c in (a, b))
    return f"CASE WHEN split_part({a}, ';', 1) = split_part({b}, ';', 1) THEN 1.0::DOUBLE ELSE coalesce(2.0::DOUBLE * len(list_intersect({x}, {y})) / nullif(len({x}) + len({y}), 0), 0.0::DOUBLE) END"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM d),
e AS (SELECT doc_id, text, next_text, length(text) AS n_chars,
  substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) AS edited FROM o),
f AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_sql_fingerprint("text")} AS fingerprint,
  {_sql_fingerprint("edited")} AS edited_fingerprint, {_sql_fingerprint("next_text")} AS next_fingerprint FROM e)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  {_sql_likeness("fingerprint", "edited_fingerprint")} AS near_edited,
  {_sql_likeness("fingerprint", "next_fingerprint")} AS near_next
FROM f
"""
