"""Documents from tables (S7, S8, S10, S11) and the adapter for the driver's ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, not_blank


def documents_from_table(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """A text table as documents: ``doc_ord`` is the table's own ordinal key, content is normalised.

    Blank documents are dropped (they have no number). ``keep``: other columns to carry.
    """
    # blank texts are found in the raw column: a filter on the cleaned one would clean every text twice
    return df.filter(not_blank(text_col)).select(
        *(keep or []),
        F.col(id_col).alias("doc_id"),
        F.col(id_col).cast("long").alias("doc_ord"),
        clean_text(F.col(text_col)).alias("content"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.concat(F.lit("table/"), F.col(id_col).cast("string")).alias("path"),
    )


def render_value(c) -> "F.Column":
    """A cell as text: null -> '' (numbers as Spark prints them)."""
    return F.coalesce(c.cast("string"), F.lit(""))


def rows_to_text(
    df: DataFrame,
    *,
    columns: list[str] | None = None,
    title: str | None = None,
    order_by: list[str],
    group_by: list[str] | None = None,
    rows_per_doc: int | None = None,
    bytes_per_doc: int | None = None,
) -> DataFrame:
    """``记录 i`` then ``col: value`` lines per row, records stripped and joined by a blank line,
    title first. One document per group, or per ``rows_per_doc`` records, or per about ``bytes_per_doc`` bytes of
    records (prefix sums, so a group of any size is many tasks).

    Output: group columns, ``part`` (0-based), ``content``.
    """
    from pyspark.sql import Window

    from ..functions.text import strip

    columns = columns or [c for c in df.columns]
    group_by = group_by or []
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), render_value(F.col(c))) for c in columns])
    from ..plans.ordinals import with_ordinal

    # record numbers per group without one task per group (a hot group spans several partitions)
    rec = with_ordinal(df, order_by, "_i", start=1, partition_by=group_by).select(
        *group_by, "_i", strip(F.concat(F.lit("记录 "), F.col("_i").cast("string"), F.lit("\n"), lines)).alias("_sec")
    )
    part = F.floor((F.col("_i") - 1) / rows_per_doc).cast("int") if rows_per_doc else F.lit(0)
    rec = rec.withColumn("part", part).filter(F.length("_sec") > 0)
    if bytes_per_doc:
        from ..plans.strings import ordered_parts

        grouped = ordered_parts(rec.drop("part"), group_by, ["_i"], "_sec", "\n\n", bytes_per_doc, "_body")
    elif rows_per_doc:
        # a document holds at most rows_per_doc records: one ordered collect per document
        grouped = rec.groupBy(*group_by, "part").agg(F.array_sort(F.collect_list(F.struct("_i", "_sec"))).alias("_r"))
        grouped = grouped.select(*group_by, "part", F.array_join(F.transform("_r", lambda r: r["_sec"]), "\n\n").alias("_body"))
    else:
        from ..plans.strings import ordered_join

        grouped = ordered_join(rec, group_by + ["part"], ["_i"], "_sec", "\n\n", "_body")
    body = F.col("_body")
    content = strip(F.concat(F.lit(f"{title}\n\n"), body)) if title else body
    return grouped.select(*group_by, "part", content.alias("content"))


def csv_cell(c) -> "F.Column":
    """A cell for CSV text: null -> '', quoted (quotes doubled) when it holds a comma, quote or line break."""
    v = render_value(c)
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def table_to_text(
    df: DataFrame,
    *,
    columns: list[str] | None = None,
    order_by: list[str],
    group_by: list[str] | None = None,
    title_col: str | None = None,
    title_prefix: str = "工作表: ",
) -> DataFrame:
    """CSV text (header, all cells as strings, minimal quoting) per group, optionally titled
    ``工作表: <title>``; a table without rows is ``(空表)``. Output: group columns, ``content``."""
    from pyspark.sql import Window

    columns = columns or [c for c in df.columns if c not in (group_by or [])]
    group_by = group_by or []
    header = ",".join(('"' + c.replace('"', '""') + '"') if any(ch in c for ch in '",\r\n') else c for c in columns)
    line = F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns])
    from ..functions.text import strip
    from ..plans.strings import ordered_join

    keys = group_by + ([title_col] if title_col and title_col not in group_by else [])
    lines = df.select(*keys, *[c for c in order_by if c not in keys], line.alias("_line"))
    g = ordered_join(lines, keys, order_by, "_line", "\n", "_body")
    text = strip(F.concat(F.lit(header + "\n"), F.col("_body")))
    text = F.when(F.length(text) > 0, text).otherwise(F.lit("(空表)"))
    if title_col:
        text = F.concat(F.lit(title_prefix), F.col(title_col).cast("string"), F.lit("\n"), text)
    out = g.select(*keys, text.alias("content"))
    if not keys:
        # a whole table without rows is still a document: its header line (or the empty-table mark)
        spark = df.sparkSession
        empty_text = header.strip() or "(空表)"
        fallback = spark.createDataFrame([(0, empty_text)], "_k int, content string")
        present = out.select(F.lit(0).alias("_k")).limit(1)
        out = out.unionByName(fallback.join(present, "_k", "left_anti").drop("_k"))
    return out


def assemble_parts(df: DataFrame, *, doc_key: list[str], part_key: str, text: str, kind: str = "paragraphs",
                   sub_key: str | None = None, bytes_per_doc: int | None = None) -> DataFrame:
    """Parts (pages, paragraphs, slides' shapes) -> one document per ``doc_key``.

    ``pages``: stripped non-blank parts joined by a line break; ``paragraphs``: by a blank line;
    ``slides``: per slide (``part_key`` = slide number) ``幻灯片 n`` then its shape texts (ordered by
    ``sub_key``) one per line, slides without text dropped, slides joined by a blank line. ``bytes_per_doc``: documents
    in numbered parts (``part``) of about that size, for a key of any size.
    """
    from ..functions.text import strip

    from ..plans.strings import ordered_join, ordered_parts

    def joined(rows: DataFrame, order: list[str], column: str, sep: str) -> DataFrame:
        if bytes_per_doc:
            return ordered_parts(rows, doc_key, order, column, sep, bytes_per_doc, "content")
        return ordered_join(rows, doc_key, order, column, sep, "content")

    t = strip(F.col(text))
    if kind in ("pages", "paragraphs"):
        sep = "\n" if kind == "pages" else "\n\n"
        parts = df.filter(F.length(t) > 0).select(*doc_key, part_key, *([sub_key] if sub_key else []), t.alias("_t"))
        order = [part_key] + ([sub_key] if sub_key else [])
        return joined(parts, order, "_t", sep)
    if kind != "slides":
        raise ValueError(f"unknown part kind {kind!r}")
    shapes = df.filter(F.col(text).isNotNull() & (F.length(t) > 0)).select(
        *doc_key, part_key, *([sub_key] if sub_key else []), t.alias("_t"))
    slides = ordered_join(shapes, doc_key + [part_key], [sub_key] if sub_key else [part_key], "_t", "\n", "_shapes")
    slides = slides.select(*doc_key, part_key, F.concat(F.lit("幻灯片 "), F.col(part_key).cast("string"), F.lit("\n"), F.col("_shapes")).alias("_slide"))
    return joined(slides, [part_key], "_slide", "\n\n")


# Table-document titles, sources and types.
QUERY_TITLE = "MySQL 自定义查询结果"
TABLE_TITLE = "MySQL 表: {table}"
IDENTIFIER_REGEX = r"^[A-Za-z0-9_]+$"
DEFAULT_ROWS_PER_TABLE = 500


def safe_identifier(name: str) -> str:
    import re

    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError(f"unsafe table name: {name!r}")
    return name


def table_document(df: DataFrame, *, source: str, path: str, document_type: str, title: str, order_by: list[str],
                   limit: int | None = None) -> DataFrame:
    """One table (or query result) -> one document: first ``limit`` rows in ``order_by`` order as
    record text (S8). The limit is the feature (a bounded preview per table), applied as a top-n."""
    rows = df.orderBy(*order_by).limit(limit) if limit else df
    recs = rows_to_text(rows, columns=df.columns, title=title, order_by=order_by)
    return recs.filter(F.length("content") > 0).select(
        F.lit(source).alias("source"), F.lit(path).alias("path"), F.lit(source).alias("file_name"),
        F.lit(source).alias("file_stem"), F.lit("").alias("file_suffix"), F.lit(source).alias("relative_path"),
        F.lit("").alias("parent_dir"), F.lit(document_type).alias("document_type"), "content",
    )


def load_table_documents(spark, tables: list[str], *, query: str | None = None, order_by: dict | None = None,
                         limit: int = DEFAULT_ROWS_PER_TABLE, base_path: str = "catalog://default") -> DataFrame:
    """The custom query first (one document), then each named table (``LIMIT limit`` rows in an
    explicit order, one document each), in list order. Tables come from the catalog (or any source
    registered as a view, e.g. a JDBC table)."""
    order_by = order_by or {}
    parts = []
    if query:
        q = spark.sql(query)
        parts.append(table_document(q, source="mysql_query", path=f"{base_path}/query", document_type="mysql_query",
                                    title=QUERY_TITLE, order_by=order_by.get("__query__", q.columns[:1])))
    for t in tables:
        t = safe_identifier(t)
        tdf = spark.table(t)
        parts.append(table_document(tdf, source=f"mysql_table:{t}", path=f"{base_path}/{t}", document_type="mysql_table",
                                    title=TABLE_TITLE.format(table=t), order_by=order_by.get(t, tdf.columns[:1]), limit=limit))
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("doc_ord", F.lit(i).cast("long"))
        out = p if out is None else out.unionByName(p)
    return out


def catalog_summary(spark) -> DataFrame:
    """Database, version, table count and the first 20 table names."""
    tables = spark.catalog.listTables()
    names = [t.name for t in tables]
    return spark.createDataFrame(
        [(spark.catalog.currentDatabase(), spark.version, len(names), names[:20])],
        "database string, version string, table_count int, sample_tables array<string>",
    )


def preview_table(spark, table: str, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows of a table in an explicit order (a bounded top-n) with the row count."""
    t = spark.table(safe_identifier(table))
    rows = t.orderBy(*(order_by or t.columns[:1])).limit(n)
    return rows.withColumn("row_count", F.count("*").over(Window.partitionBy()))
