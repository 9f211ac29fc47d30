"""Parsing, normalising, chunking and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalogue.tables import table
from quire.config import Chunking
from quire.functions import ids, tabular
from quire.functions import text as T
from quire.operators import chunking, validate
from quire.operators.normalize import normalize_blocks
from quire.plans.ingest import aligned
from quire.session import new_folder
from quire.sources import plain, structured



def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text", "source", "lang")


def text_lines_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = plain.text_blocks(corpus(spark, sf_dir))
    return blocks.select(F.col("document_id").cast("long").alias("doc_id"), F.col("block_order").cast("long").alias("block_order"), "block_type", "text", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = plain.markdown_blocks(corpus(spark, sf_dir))
    return blocks.select("document_id", F.col("block_order").cast("long").alias("block_order"), "block_type", "text", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


def normalize_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.prose(F.col("text")).alias("text"))


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("tokens"))


def token_windows_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("words"))
    return words.select("doc_id", F.posexplode(T.windows_of(F.col("words"), 350, 60)).alias("n", "text")).select("doc_id", F.col("n").cast("long").alias("n"), F.md5("text").alias("digest"))


def stable_document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", ids.document_id(F.lit(None).cast("string"), F.col("source"), F.col("doc_id"), F.col("lang")).alias("id"))


def structure_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = chunking.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "island")
    return runs.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event")).withColumn("island", F.col("island").cast("long"))


def pack_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph sizes of each document packed into bins of 350 tokens with an overlap of 60."""
    sizes = F.transform(T.lines(F.col("text")), lambda x: F.greatest(F.lit(1), T.token_count(x)))
    packed = chunking.with_ranges(table(spark, sf_dir, "documents").select("doc_id", sizes.alias("sizes")), "sizes", 350, 60)
    bins = packed.select("doc_id", "sizes", F.posexplode("ranges").alias("bin", "r"))
    total = F.aggregate(F.slice("sizes", F.col("r.first") + 1, F.col("r.last") - F.col("r.first") + 1), F.lit(0), lambda a, x: a + x)
    return bins.select("doc_id", *[c.cast("long").alias(n) for n, c in (("bin", F.col("bin")), ("first", F.col("r.first")), ("last", F.col("r.last")), ("tokens", total))])


def chunked(spark: SparkSession, sf_dir: str, work: str | None = None) -> tuple[DataFrame, DataFrame]:
    docs = corpus(spark, sf_dir)
    blocks = normalize_blocks(aligned(plain.text_blocks(docs)))
    named = docs.select("document_id", F.col("source").alias("title"), F.col("source").alias("file_name"), F.lit("txt").alias("file_type"), F.lit(None).cast("string").alias("source_path"))
    return chunking.chunk(blocks.join(named, "document_id"), Chunking(), work=work)


def parent_child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, children = chunked(spark, sf_dir)
    return children.select("document_id", F.col("child_index").cast("long").alias("child_index"), "id", "parent_chunk_id", F.col("token_count").cast("long").alias("token_count"), F.md5("text").alias("digest"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each document under headings that change every six blocks and come again after eighteen."""
    docs = corpus(spark, sf_dir)
    part = F.concat(F.lit("Part "), (F.floor(F.col("block_order") / 6) % 3).cast("string"))
    blocks = normalize_blocks(aligned(plain.text_blocks(docs).withColumn("parent_path", F.array(F.lit("Book"), part))))
    return blocks.join(docs.select("document_id", F.col("source").alias("title"), F.col("source").alias("file_name"), F.lit("md").alias("file_type"), F.lit(None).cast("string").alias("source_path")), "document_id")


def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent chunks under headings: a chunk never holds two sections, and the same heading later is another section."""
    parents, _ = chunking.chunk(sections(spark, sf_dir), Chunking(parent_target=150, parent_hard_max=200))
    return parents.select("document_id", F.col("parent_index").cast("long").alias("parent_index"), "id", "structure_key", F.array_join("parent_path", "/").alias("path"), F.size("block_orders").cast("long").alias("n_blocks"), F.md5("text").alias("digest"))


def chunk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children by document once the first parents of every tenth document are gone."""
    parents, children = chunked(spark, sf_dir, new_folder(spark, "chunks"))
    left = parents.filter((F.col("parent_index") > 0) | (F.col("document_id").cast("long") % 10 > 0))
    return chunking.orphans(left, children).groupBy("document_id").agg(F.count(F.lit(1)).alias("orphans"))


def block_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return validate.block_sets(c, "conv_id", "id", "turn").select("conv_id", "n_blocks", "min_order", "max_order", "code")


def key_value_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    headers = tabular.dedupe_headers(F.array(F.lit("name"), F.lit(""), F.lit("name")))
    values = F.array(F.col("c_name"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), F.when(F.col("c_acctbal") < 0, "overdrawn").otherwise(""))
    return c.select("c_custkey", tabular.key_value_row(headers, values).alias("text"))


def source_ref_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    ref = ids.source_ref(F.col("l_orderkey"), none.cast("int"), F.nullif("l_returnflag", F.lit("N")), F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_linenumber") % 2, none.cast("int"), none.cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy(ref.alias("ref")).agg(F.count(F.lit(1)).alias("n"))


def json_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's JSON beside a list and a scalar, by the JSON source: blocks of the innermost containers, and of scalars beside containers."""
    text = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "a b": ['), F.col("props"), F.lit(', [1, "x"]]}'))
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("document_id"), text.alias("text"))
    return structured.json_blocks(events).select(F.col("document_id").cast("long").alias("event_id"), "json_path", "text")


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as CSV files, by the CSV source."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.col("turn").cast("string"), F.lit(',"'), F.col("role"), F.lit(', so ""said"""')).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    files = c.groupBy(F.col("conv_id").cast("string").alias("document_id")).agg(F.concat(F.lit("turn,role\n"), body).alias("text"))
    return structured.csv_blocks(files).select(F.col("document_id").cast("long").alias("conv_id"), F.col("row_no").cast("long").alias("row_no"), "text")


def excerpt_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"), T.preview(F.col("text")).alias("preview"))


def citation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn").cast("string")
    marked = F.concat(F.lit("["), turn, F.lit("] "), F.col("text"), F.lit(" 【"), turn, F.lit("†x】 `[2]` [3](x) [a]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.linked_citations(marked).alias("text"))


def url_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "://", "://user:secret@")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.redacted_url(given).alias("url"))


def content_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of five kinds, by number."""
    kind, html = F.col("page_id") % 5, F.col("html")
    content = F.when(kind == 1, F.concat(F.lit("%PDF-1.7 "), html)).when(kind == 2, F.concat(F.lit('{"page": '), F.col("page_id").cast("string"), F.lit("}"))).when(kind == 3, F.concat(F.lit("{"), html)).when(kind == 4, F.concat(F.lit("\x00"), html)).otherwise(html)
    ext = F.when(kind == 1, ".pdf").when(kind.isin(2, 3), ".json").otherwise(".txt")
    return table(spark, sf_dir, "pages").select("page_id", validate.content_type(content.cast("binary"), ext).alias("detected"), F.length("html").cast("long").alias("n_chars"))


def eval_missing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document holds the license terms of an evaluation case."""
    terms = F.array(F.lit("Licensed"), F.lit("licenses this"), F.lit("GNU General"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.missing_terms(T.match_form(F.col("text")), terms), "|").alias("missing"))


WORDS = "regexp_extract_all(text, '[^ \\n]+')"
SINGULAR = "CASE WHEN length(w) > 3 AND w LIKE '%ies' THEN regexp_replace(w, 'ies$', 'y') WHEN length(w) > 3 AND w LIKE '%s' THEN regexp_replace(w, 's$', '') ELSE w END"
FORM = f"array_to_string(list_transform(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+'), lambda w: {SINGULAR}), ' ')"


def miss_sql(term: str, form: str) -> str:
    words = form.split()
    every = " AND ".join(f"list_contains(ws, '{w}')" for w in words) if len(words) > 1 else "false"
    return f"CASE WHEN contains(f, '{form}') OR ({every}) THEN NULL ELSE '{term}' END"


def packed_sql(name: str, source: str, target: int, overlap: int) -> str:
    """A recursive table that folds `source` (key, segs, sizes) into bins, as pack_ranges does, and a table {name}_bins of key, segs, n, first, last."""
    return f"""
        {name} AS (
            SELECT key, segs, sizes, 0::BIGINT AS i, 0::BIGINT AS first, 0::BIGINT AS used, []::STRUCT(a BIGINT, b BIGINT)[] AS done FROM {source}
            UNION ALL
            SELECT key, segs, sizes, i + 1, CASE WHEN over THEN i ELSE f END, CASE WHEN over THEN 0 ELSE u END + size, d FROM (
                SELECT *, closes AND u + size > {target} AS over FROM (
                    SELECT *, CASE WHEN closes THEN coalesce(list_sum(sizes[f + 1 : i]), 0) ELSE used END AS u FROM (
                        SELECT *, CASE WHEN closes THEN coalesce(list_min(list_filter(range(first, i), lambda j: list_sum(sizes[j + 1 : i]) <= {overlap})), i) ELSE first END AS f,
                               CASE WHEN closes THEN list_append(done, {{'a': first, 'b': i - 1}}) ELSE done END AS d FROM (
                            SELECT *, i > first AND used + size > {target} AS closes FROM (SELECT *, sizes[i + 1] AS size FROM {name} WHERE i < len(sizes))))))
        ), {name}_bins AS (
            SELECT key, segs, sizes, n::BIGINT - 1 AS n, bins[n].a AS first, bins[n].b AS last FROM (
                SELECT key, segs, sizes, bins, unnest(range(1, len(bins) + 1)) AS n FROM (SELECT key, segs, sizes, list_append(done, {{'a': first, 'b': i - 1}}) AS bins FROM {name} WHERE i = len(sizes) AND i > 0))
        )"""


def pieces_sql(hard_max: int, target: int, overlap: int) -> str:
    """Segments of a text with words ws: structs of number i, count c, text t, tokens z."""
    step = target - overlap
    count = f"(greatest(0, ceil((len(ws) - {target}) / {step}.0))::BIGINT + 1)"
    window = f"ws[k * {step} + 1 : k * {step} + {target}]"
    return f"""CASE WHEN len(ws) <= {hard_max} THEN [{{'i': 0::BIGINT, 'c': 1::BIGINT, 't': text, 'z': greatest(1, len(ws))::BIGINT}}]
        ELSE list_transform(range(0, {count}), lambda k: {{'i': k, 'c': {count}, 't': array_to_string({window}, ' '), 'z': greatest(1, len({window}))::BIGINT}}) END"""


FINGERPRINT = "array_to_string(list_transform(own, lambda s: s.o || ':' || s.ref || ':' || s.i || ':' || s.c), '|')"


def chunks_sql(blocks: str) -> str:
    """Tables parents (key, n, id, own) and children of blocks of plain text, all of one group."""
    return f"""
        WITH RECURSIVE b AS ({blocks}),
        n AS (SELECT doc_id, block_order AS o, trim(regexp_replace(text, '[ \t]+', ' ', 'g')) AS text, 'lines:' || line_start || CASE WHEN line_end <> line_start THEN '-' || line_end ELSE '' END AS ref FROM b),
        w AS (SELECT *, regexp_extract_all(text, '[^ ]+') AS ws FROM n),
        parent_rows AS (SELECT doc_id, o, ref, unnest({pieces_sql(2000, 1200, 0)}) AS p FROM w),
        parent_segs AS (SELECT doc_id AS key, list({{'o': o, 'ref': ref, 'i': p.i, 'c': p.c, 't': p.t}} ORDER BY o, p.i) AS segs, list(p.z ORDER BY o, p.i) AS sizes FROM parent_rows GROUP BY doc_id),
        {packed_sql("parent_fold", "parent_segs", 1200, 0)},
        parents AS (SELECT key, n, own, left(sha256(key || chr(31) || 'parent' || chr(31) || n || chr(31) || 'document:root' || chr(31) || {FINGERPRINT}), 24) AS id FROM (SELECT key, n, segs[first + 1 : last + 1] AS own FROM parent_fold_bins)),
        spread AS (SELECT key, n, id, unnest(range(1, len(own) + 1)) AS pos, own FROM parents),
        child_words AS (SELECT key, n, id, pos, own[pos].o AS o, own[pos].ref AS ref, own[pos].t AS text, regexp_extract_all(own[pos].t, '[^ ]+') AS ws FROM spread),
        child_rows AS (SELECT key, n, id, pos, o, ref, unnest({pieces_sql(350, 350, 60)}) AS p FROM child_words),
        child_segs AS (SELECT {{'doc': key, 'parent': n, 'id': id}} AS key, list({{'o': o, 'ref': ref, 'i': p.i, 'c': p.c, 't': p.t}} ORDER BY pos, p.i) AS segs, list(p.z ORDER BY pos, p.i) AS sizes FROM child_rows GROUP BY key, n, id),
        {packed_sql("child_fold", "child_segs", 350, 60)},
        children AS (SELECT key.doc AS doc_id, key.parent AS parent_index, key.id AS parent_chunk_id, row_number() OVER (PARTITION BY key.doc ORDER BY key.parent, n) - 1 AS child_index, segs[first + 1 : last + 1] AS own FROM child_fold_bins)"""


# Of Markdown, the documents have list items and paragraphs alone: the tests hold all other blocks.
MARKDOWN_SQL = r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    k AS (SELECT doc_id, n, line, trim(line) AS bare, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^\s*([-*+]|\d+[.)])\s+') THEN 'list_item' ELSE 'paragraph' END AS kind FROM l),
    o AS (SELECT *, CASE WHEN kind = 'paragraph' AND arg_max(kind, n) FILTER (WHERE kind <> 'paragraph') OVER (PARTITION BY doc_id ORDER BY n) = 'list_item' THEN 'list_item' ELSE kind END AS own FROM k),
    g AS (SELECT *, sum(CASE WHEN kind = 'list_item' OR prev IS NULL OR prev <> own THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM (SELECT *, lag(own) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM o)),
    b AS (SELECT doc_id, own AS block_type, min(n) AS line_start, max(n) AS line_end, trim(CASE WHEN own = 'list_item' THEN regexp_replace(string_agg(bare, ' ' ORDER BY n), '^\s*([-*+]|\d+[.)])\s+', '') ELSE string_agg(bare, ' ' ORDER BY n) END) AS text
          FROM g WHERE own <> 'blank' GROUP BY doc_id, own, run)
    SELECT doc_id::VARCHAR AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_start) - 1 AS block_order, block_type, text, line_start, line_end FROM b WHERE text <> ''"""


ORACLE_SQL = {
    "text_lines_blocks": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, length(text) AS len, text FROM documents),
        k AS (SELECT doc_id, n, line, trim(line) AS bare,
                     CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^\s*([-*+]|\d+[.)])\s+') THEN 'list_item' ELSE 'paragraph' END AS kind FROM l),
        g AS (SELECT *, sum(CASE WHEN kind = 'list_item' OR prev IS NULL OR prev <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS run
              FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM k)),
        b AS (SELECT doc_id, kind AS block_type, min(n) AS line_start, max(n) AS line_end,
                     trim(CASE WHEN kind = 'list_item' THEN regexp_replace(min(line), '^\s*([-*+]|\d+[.)])\s+', '') ELSE string_agg(bare, ' ' ORDER BY n) END) AS text
              FROM g WHERE kind <> 'blank' GROUP BY doc_id, kind, run)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_start) - 1 AS block_order, block_type, text, line_start, line_end FROM b WHERE text <> ''""",
    "normalize_prose": "SELECT doc_id, trim(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x), '[ \\t]+', ' ', 'g')), lambda x: x <> ''), chr(10)), ' ' || chr(10)) AS text FROM documents",
    "token_count": f"SELECT doc_id, len({WORDS})::BIGINT AS tokens FROM documents",
    "token_windows_overlap": f"""
        WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents)
        SELECT doc_id, n, md5(array_to_string(ws[n * 290 + 1 : n * 290 + 350], ' ')) AS digest
        FROM (SELECT doc_id, ws, unnest(generate_series(0, greatest(0, ceil((len(ws) - 350) / 290.0))::BIGINT)) AS n FROM w WHERE len(ws) > 0)""",
    "stable_document_id": "SELECT doc_id, left(sha256('document' || chr(31) || '' || chr(31) || source || chr(31) || doc_id || chr(31) || lang), 24) AS id FROM documents",
    "structure_islands": """
        WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        g AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS island FROM c)
        SELECT user_id, island::BIGINT AS island, min(event_type) AS event_type, count(*) AS n_events, min(event_id) AS first_event FROM g GROUP BY user_id, island""",
    "block_validation": """
        SELECT conv_id, count(*) AS n_blocks, min(turn) AS min_order, max(turn) AS max_order,
               CASE WHEN count(DISTINCT turn) < count(*) THEN 'DUPLICATE_BLOCK_ID' WHEN min(turn) <> 0 OR max(turn) <> count(*) - 1 THEN 'INVALID_BLOCK_ORDER' END AS code
        FROM conversations GROUP BY conv_id""",
    "key_value_row": "SELECT c_custkey, 'name: ' || c_name || ' | column_2: ' || c_nationkey || ' | name_2: ' || c_mktsegment || CASE WHEN c_acctbal < 0 THEN ' | column_4: overdrawn' ELSE '' END AS text FROM customer",
    "source_ref_format": """
        SELECT 'page:' || l_orderkey || CASE WHEN l_returnflag <> 'N' THEN ';sheet:' || l_returnflag ELSE '' END || ';lines:' || l_linenumber || CASE WHEN l_linenumber % 2 = 1 THEN '-' || (l_linenumber + 1) ELSE '' END AS ref, count(*) AS n
        FROM lineitem GROUP BY 1""",
    "json_path_extract": """
        SELECT event_id, unnest(['$.user', '$."a b"[0]', '$."a b"[1]']) AS json_path, unnest(['$.user: ' || user_id, '{"k": ' || json_extract_string(props, '$.k') || '}', '[1, "x"]']) AS text FROM events""",
    "csv_rows": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS row_no, 'turn: ' || turn || ' | role: ' || role || ', so \"said\"' AS text FROM conversations",
    "excerpt_preview": r"""
        SELECT doc_id, CASE WHEN length(c) <= 520 THEN c ELSE rtrim(left(c, 517)) || '...' END AS excerpt, CASE WHEN length(text) <= 500 THEN text ELSE left(text, 500) || '...' END AS preview
        FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)""",
    # No message has brackets or code of its own, so the marks added are all there is to link.
    "citation_linking": "SELECT conv_id, turn, '[' || turn || '](#source-' || turn || ') ' || text || ' [' || turn || '](#source-' || turn || ') `[2]` [3](x) [a]' AS text FROM conversations",
    "url_redaction": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, '://', '://***@') ELSE url END AS url FROM pages",
    "content_sniff": "SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'pdf' WHEN 2 THEN 'json' WHEN 4 THEN 'binary' ELSE 'text' END AS detected, length(html) AS n_chars FROM pages",
    "eval_missing_terms": f"""
        SELECT doc_id, array_to_string(list_filter([{miss_sql("Licensed", "licensed")}, {miss_sql("licenses this", "license thi")}, {miss_sql("GNU General", "gnu general")}], lambda x: x IS NOT NULL), '|') AS missing
        FROM (SELECT doc_id, f, string_split(f, ' ') AS ws FROM (SELECT doc_id, {FORM} AS f FROM documents))""",
}
ORACLE_SQL["markdown_blocks"] = MARKDOWN_SQL
ORACLE_SQL["pack_segments"] = f"""
    WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
    s AS (SELECT doc_id AS key, NULL AS segs, list_transform(CASE WHEN parts[-1] = '' THEN parts[1 : len(parts) - 1] ELSE parts END, lambda x: greatest(1, len(regexp_extract_all(x, '[^ \\n]+')))::BIGINT) AS sizes FROM l),
    {packed_sql("fold", "s", 350, 60)}
    SELECT key AS doc_id, n AS bin, first, last, list_sum(sizes[first + 1 : last + 1])::BIGINT AS tokens FROM fold_bins"""
ORACLE_SQL["heading_chunks"] = f"""
    WITH RECURSIVE b AS ({ORACLE_SQL["text_lines_blocks"]}),
    n AS (SELECT doc_id, block_order AS o, 'Part ' || (block_order // 6 % 3) AS part, block_order // 6 AS island, trim(regexp_replace(text, '[ \t]+', ' ', 'g')) AS text,
                 'lines:' || line_start || CASE WHEN line_end <> line_start THEN '-' || line_end ELSE '' END AS ref FROM b),
    w AS (SELECT *, regexp_extract_all(text, '[^ ]+') AS ws FROM n),
    parent_rows AS (SELECT doc_id, island, part, o, ref, unnest({pieces_sql(200, 150, 0)}) AS p FROM w),
    segs AS (SELECT {{'doc': doc_id, 'island': island, 'part': part}} AS key, list({{'o': o, 'ref': ref, 'i': p.i, 'c': p.c, 't': p.t}} ORDER BY o, p.i) AS segs, list(p.z ORDER BY o, p.i) AS sizes FROM parent_rows GROUP BY doc_id, island, part),
    {packed_sql("fold", "segs", 150, 0)},
    parents AS (SELECT key.doc AS doc_id, key.part AS part, row_number() OVER (PARTITION BY key.doc ORDER BY key.island, n) - 1 AS parent_index, segs[first + 1 : last + 1] AS own FROM fold_bins)
    SELECT p.doc_id::VARCHAR AS document_id, parent_index, 'heading:Book > ' || part AS structure_key, 'Book/' || part AS path, len(list_distinct(list_transform(own, lambda s: s.o))) AS n_blocks,
           left(sha256(p.doc_id || chr(31) || 'parent' || chr(31) || parent_index || chr(31) || 'heading:Book > ' || part || chr(31) || {FINGERPRINT}), 24) AS id,
           md5('Document: ' || d.source || chr(10) || 'Section: Book > ' || part || chr(10) || chr(10) || array_to_string(list_transform(own, lambda s: trim(s.t)), chr(10) || chr(10))) AS digest
    FROM parents p JOIN documents d ON d.doc_id = p.doc_id
"""
ORACLE_SQL["parent_child_chunks"] = f"""
    {chunks_sql(ORACLE_SQL["text_lines_blocks"])},
    titled AS (SELECT c.*, 'Document: ' || d.source || chr(10) || 'Section: ' || d.source || chr(10) || chr(10) || array_to_string(list_filter(list_transform(own, lambda s: trim(s.t)), lambda t: t <> ''), chr(10) || chr(10)) AS text FROM children c JOIN documents d USING (doc_id))
    SELECT doc_id::VARCHAR AS document_id, child_index, left(sha256(doc_id || chr(31) || 'child' || chr(31) || child_index || chr(31) || parent_chunk_id || chr(31) || {FINGERPRINT}), 24) AS id, parent_chunk_id,
           greatest(1, len(regexp_extract_all(text, '[^ \\n]+')))::BIGINT AS token_count, md5(text) AS digest FROM titled"""
ORACLE_SQL["chunk_orphans"] = f"""
    {chunks_sql(ORACLE_SQL["text_lines_blocks"])}
    SELECT doc_id::VARCHAR AS document_id, count(*) AS orphans FROM children WHERE parent_index = 0 AND doc_id % 10 = 0 GROUP BY doc_id"""
QUERIES = {f.__name__: f for f in (
    text_lines_blocks, markdown_blocks, normalize_prose, token_count, token_windows_overlap, stable_document_id, structure_islands, pack_segments, parent_child_chunks, heading_chunks, chunk_orphans,
    block_validation, key_value_row, source_ref_format, json_path_extract, csv_rows, excerpt_preview, citation_linking, url_redaction, content_sniff, eval_missing_terms,
)}
