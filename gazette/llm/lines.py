"""Dropping lines that follow a template recurring across documents.

Lines are parsed down a tree of fixed depth: the number of tokens, then the first ``depth`` tokens. Tokens
with a digit are variable fields. In a leaf, a token stays constant at its place if enough documents
have it there; any other becomes ``<*>``. What results is the line's template. A template that enough
documents carry, and that is constant for the most part, is recurring.

A document that consists of recurring lines for the most part is a copy of other documents rather
than a carrier of boilerplate. Its lines stay, because copies are for document dedup to judge. That is the
rule of ``drop_recurring_lines``, which SQL gives too. ``drop_lines_across_copies`` exempts nothing:
near copies are found first and count as one document, and every document is judged line by line.

Lines travel as hashes of leaf and masked tokens; only one carrier of each distinct line in a leaf with
enough documents is read again for its tokens. Support is counted in distinct (document, line)
pairs, combined on the map side, so a leaf or template with very many lines is no hot spot.
"""

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gazette.llm.blocks import column, slices, texts
from gazette.llm.jaccard import near_duplicate_groups
from gazette.llm.registry import query, table
from gazette.plans.store import materialise

DEPTH = 3
MIN_DOCS = 10
MIN_CONSTANT = 60
LONG_TOKENS = 50
LONG_DOCS = 2
COPY_PERCENT = 80
FIELD = b"<*>"
_DIGIT = re.compile(rb"[0-9]")


def masked(line: bytes) -> list[bytes]:
    """Tokens between ASCII white space; those with a digit are variable."""
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [FIELD if _DIGIT.search(t) else t for t in tokens]
    return tokens


def _hash(parts: list[bytes]) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(b" ".join(parts)) - (1 << 63)


def _parsed(rows: DataFrame, depth: int, long_tokens: int | None = None) -> DataFrame:
    """``id, h, nr, chars, leaf, line`` of every line that is not blank.

    With ``long_tokens`` also ``raw``, a hash of the unmasked tokens of lines with so many; others have null.
    """
    names = ["id", "h", "nr", "chars", "leaf", "line", *["raw"] * (long_tokens is not None)]

    def run(batches):
        for part in slices(batches):
            ids, nr, chars, leaf, line, full = [], [], [], [], [], []
            for i, text in enumerate(texts(part)):
                for k, raw in enumerate(text.split(b"\n") if text is not None else ()):
                    tokens = masked(raw)
                    if tokens:
                        ids.append(i)
                        nr.append(k)
                        chars.append(len(raw))
                        leaf.append(_hash([b"%d" % len(tokens), *tokens[:depth]]))
                        line.append(_hash(tokens))
                        if long_tokens is not None:
                            full.append(_hash(raw.split()) if len(tokens) >= long_tokens else None)
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(at), part.column(1).take(at), pa.array(nr, pa.int32()),
                    pa.array(chars, pa.int64()), pa.array(leaf, pa.int64()), pa.array(line, pa.int64()),
                    *[pa.array(full, pa.int64())] * (long_tokens is not None),
                ],
                names=names,
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join(f"{c} {kind if c == 'id' else 'int' if c == 'nr' else 'long'}" for c in names))


def _tokens_of(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``leaf, line, n, tokens``, read again from the carrier of each line."""
    wanted = lines.select("rep.id", "rep.h", F.struct("rep.nr", "leaf", "line", "n").alias("at")).groupBy("id", "h").agg(F.collect_list("at").alias("at"))
    found = rows.join(wanted, ["id", "h"]).select("text", "at")

    def run(batches):
        for part in slices(batches):
            out = [[], [], [], []]
            for text, wants in zip(texts(part), column(part, "at"), strict=True):
                lines = text.split(b"\n")
                for w in wants:
                    out[0].append(w["leaf"])
                    out[1].append(w["line"])
                    out[2].append(w["n"])
                    out[3].append([t.decode() for t in masked(lines[w["nr"]])])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["leaf", "line", "n", "tokens"])

    # a repeated row gives its lines again
    return found.mapInArrow(run, "leaf long, line long, n long, tokens array<string>").dropDuplicates(["leaf", "line"])


def recurring_templates(rows: DataFrame, parsed: DataFrame, min_docs: int, min_constant: int) -> DataFrame:
    """``leaf, line, template, n_docs`` of every distinct line whose template recurs."""
    per_line = (
        parsed.filter("id IS NOT NULL").groupBy("leaf", "line", "id").agg(F.min(F.struct("id", "h", "nr")).alias("rep"))
        .groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
    )
    return _recurring(rows, per_line, min_docs, min_constant)


def _recurring(rows: DataFrame, per_line: DataFrame, min_docs: int, min_constant: int, pairs: DataFrame | None = None) -> DataFrame:
    """``recurring_templates`` from ``leaf, line, n, rep``: documents and a carrier of each distinct line.

    With ``pairs`` (``leaf, line, id``) support is counted in distinct documents and ``n_docs`` left out,
    else in (document, line) pairs.
    """
    leaves = per_line.groupBy("leaf").agg(F.sum("n").alias("__n")).filter(F.col("__n") >= min_docs).select("leaf")
    lines = materialise(_tokens_of(rows, per_line.join(leaves, "leaf")))
    cells = lines.select("leaf", "line", "n", F.posexplode("tokens").alias("place", "token"))
    field = FIELD.decode()
    at = ["leaf", "place", "token"]
    if pairs is None:
        constant = cells.filter(F.col("token") != field).groupBy(*at).agg(F.sum("n").alias("support")).filter(F.col("support") >= min_docs)
    else:
        constant = _with_support(cells.filter(F.col("token") != field), at, pairs, min_docs)
    constant = constant.select(*at, F.lit(True).alias("kept"))
    slot = F.struct("place", F.when(F.col("kept"), F.col("token")).otherwise(field).alias("token"))
    templates = (
        cells.join(constant, ["leaf", "place", "token"], "left")
        .groupBy("leaf", "line", "n")
        .agg(F.array_sort(F.collect_list(slot)).alias("slots"), F.count("kept").alias("fixed"), F.count("*").alias("size"))
        .filter(F.col("fixed") * 100 >= F.col("size") * min_constant)
        .select("leaf", "line", "n", F.concat_ws(" ", F.transform("slots", lambda s: s["token"])).alias("template"))
    )
    if pairs is not None:
        return templates.join(_with_support(templates, ["leaf", "template"], pairs, min_docs), ["leaf", "template"]).select("leaf", "line", "template")
    support = templates.groupBy("leaf", "template").agg(F.sum("n").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    return templates.join(support, ["leaf", "template"]).select("leaf", "line", "template", "n_docs")


def drop_recurring_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    min_docs: int = MIN_DOCS,
    min_constant: int = MIN_CONSTANT,
    copy_percent: int = COPY_PERCENT,
) -> DataFrame:
    """``docs`` with shorter texts, and ``n_lines``, ``n_dropped`` and ``is_copy``; all rows and columns stay.

    A template recurs with ``min_docs`` distinct (document, line) pairs and ``min_constant`` percent of
    constant tokens. A text whose recurring lines hold ``copy_percent`` of the bytes of its lines that
    are not blank is a copy and stays as it is. Null texts (0 lines) and texts with a null id stay as
    they are; blank lines are never dropped. Rows of a repeated id count as one document. Columns
    named like the three new ones are replaced; names that begin with two underscores are reserved.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    parsed = materialise(_parsed(rows, depth))
    recurring = recurring_templates(rows.filter("id IS NOT NULL"), parsed, min_docs, min_constant).select("leaf", "line", F.lit(True).alias("hit"))
    found = (
        parsed.filter("id IS NOT NULL").dropDuplicates(["id", "h", "nr"]).join(recurring, ["leaf", "line"], "left")
        .groupBy("id", "h")
        .agg(
            F.sum("chars").alias("chars"),
            F.sum(F.when(F.col("hit"), F.col("chars"))).alias("recurring"),
            F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("nr")))).alias("__at"),
        )
        .filter("recurring > 0")
        .select(
            F.col("id").alias("__id"), F.col("h").alias("__h"), "__at",
            (F.col("recurring") * 100 >= F.col("chars") * copy_percent).alias("__copy"),
        )
    )
    joined = docs.withColumn("__key", F.xxhash64(text_col)).join(found, (F.col(id_col) == F.col("__id")) & (F.col("__key") == F.col("__h")), "left")
    whole = F.split(text_col, "\n", -1)
    drops = F.col("__copy").isNotNull() & ~F.col("__copy")
    cut = F.array_join(F.filter(whole, lambda line, nr: ~F.array_contains(F.col("__at"), nr)), "\n")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "is_copy")]
    return joined.select(
        *[F.when(drops, cut).otherwise(F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(whole)).cast("long").alias("n_lines"),
        F.when(drops, F.size("__at")).otherwise(0).cast("long").alias("n_dropped"),
        F.coalesce("__copy", F.lit(False)).alias("is_copy"),
    )


def _carriers(parsed: DataFrame, copies: DataFrame) -> DataFrame:
    """``parsed`` rows with an id once each, with ``copy_of``: the id that stands for all near copies of the document."""
    once = parsed.filter("id IS NOT NULL").dropDuplicates(["id", "h", "nr"])
    return once.join(copies, "id", "left").withColumn("copy_of", F.coalesce("copy_of", "id"))


def _with_support(cells: DataFrame, keys: list[str], pairs: DataFrame, least: int) -> DataFrame:
    """``keys`` of ``cells`` (``leaf, line, n`` and ``keys``) whose lines stand in ``least`` distinct documents together.

    The largest and the sum of the lines' own counts settle most; only lines of keys in between are
    joined with their documents (``pairs``: ``leaf, line, id``), so no line of them has ``least``.
    """
    bounds = cells.groupBy(*keys).agg(F.max("n").alias("most"), F.sum("n").alias("sum")).filter(F.col("sum") >= least)
    counted = (
        cells.join(bounds.filter(F.col("most") < least), keys, "left_semi").select("line", *keys).join(pairs, ["leaf", "line"])
        .select(*keys, "id").distinct().groupBy(*keys).count().filter(F.col("count") >= least)
    )
    return bounds.filter(F.col("most") >= least).select(*keys).unionByName(counted.select(*keys))


def _recurring_across_copies(rows: DataFrame, carriers: DataFrame, min_docs: int, min_constant: int) -> DataFrame:
    """``leaf, line`` of every distinct line whose template recurs in documents that are not near copies."""
    counted = carriers.select("leaf", "line", F.col("copy_of").alias("id"), F.struct("id", "h", "nr").alias("rep"))
    pairs = materialise(counted.groupBy("leaf", "line", "id").agg(F.min("rep").alias("rep")))
    per_line = pairs.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
    return _recurring(rows, per_line, min_docs, min_constant, pairs.select("leaf", "line", "id")).select("leaf", "line")


def _later_long_lines(carriers: DataFrame, long_docs: int) -> DataFrame:
    """``id, h, nr`` of long lines that ``long_docs`` documents have word for word, but for those of one document.

    That one is a document that near-copy removal keeps, if any has the line, and then has the smallest id;
    its near copies keep the line with it.
    """
    long = carriers.filter("raw IS NOT NULL")
    per_copy = long.groupBy("raw", "copy_of").agg(F.min(F.col("id") != F.col("copy_of")).alias("later"))
    shared = (
        per_copy.groupBy("raw").agg(F.count("*").alias("n"), F.min(F.struct("later", "copy_of")).alias("first"))
        .filter(F.col("n") >= long_docs).select("raw", F.col("first.copy_of").alias("keeper"))
    )
    return long.join(shared, "raw").filter(F.col("copy_of") != F.col("keeper")).select("id", "h", "nr")


def drop_lines_across_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    min_docs: int = MIN_DOCS,
    min_constant: int = MIN_CONSTANT,
    long_tokens: int = LONG_TOKENS,
    long_docs: int = LONG_DOCS,
) -> DataFrame:
    """``docs`` with shorter texts; all rows and columns stay, and no document is exempt.

    Near copies (components of ``jaccard.near_duplicate_groups``) count as one document, so lines that
    only copies of one document share do not recur, and boilerplate goes from copies as from any
    other text. Only documents with a line that recurs when each counts for itself are compared.

    Support is counted in distinct documents: alike lines inside one document are one. A line of
    ``long_tokens`` tokens that ``long_docs`` documents share word for word, digits included, stays in one
    of them (see ``_later_long_lines``) and goes from the others; a shorter one needs ``min_docs``.
    Null texts and texts with a null id stay as they are; blank lines are never dropped.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    named = rows.filter("id IS NOT NULL")
    parsed = materialise(_parsed(rows, depth, long_tokens))
    known = parsed.filter("id IS NOT NULL")
    recurring = recurring_templates(named, parsed, min_docs, min_constant).select("leaf", "line")
    passages = known.filter("raw IS NOT NULL").select("raw", "id").distinct().groupBy("raw").count().filter(F.col("count") >= long_docs)
    suspects = known.join(recurring, ["leaf", "line"], "left_semi").select("id").unionByName(known.join(passages, "raw", "left_semi").select("id"))
    suspects = materialise(suspects.distinct())
    groups = near_duplicate_groups(named.join(suspects, "id", "left_semi"), "id")
    copies = materialise(groups.groupBy("id").agg(F.min("component_id").alias("copy_of")))
    carriers = materialise(_carriers(parsed, copies))
    hits = carriers.join(_recurring_across_copies(named, carriers, min_docs, min_constant), ["leaf", "line"], "left_semi")
    hits = hits.select("id", "h", "nr").unionByName(_later_long_lines(carriers, long_docs))
    found = hits.groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_set("nr").alias("__at"))
    joined = docs.withColumn("__key", F.xxhash64(text_col)).join(found, (F.col(id_col) == F.col("__id")) & (F.col("__key") == F.col("__h")), "left")
    cut = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda line, nr: ~F.array_contains(F.col("__at"), nr)), "\n")
    return joined.select(*[F.when(F.col("__at").isNotNull(), cut).otherwise(F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


@query(
    sql=r"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS nr
        FROM documents WHERE text IS NOT NULL
    ), t AS (
        SELECT doc_id, nr, strlen(raw) AS chars, tokens, array_to_string(tokens, ' ') AS line,
               concat_ws(' ', len(tokens), array_to_string(tokens[1:3], ' ')) AS leaf
        FROM (
            SELECT doc_id, nr, raw,
                   list_transform(regexp_extract_all(raw, '[^ \t\r\x0B\x0C]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tokens
            FROM l
        ) WHERE len(tokens) > 0
    ), per_line AS (
        SELECT leaf, line, any_value(tokens) AS tokens, count(DISTINCT doc_id) AS n FROM t GROUP BY leaf, line
    ), cell AS (
        SELECT leaf, line, n, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM per_line
    ), constant AS (
        SELECT leaf, place, token FROM cell WHERE token <> '<*>' GROUP BY ALL HAVING sum(n) >= 10
    ), template AS (
        SELECT leaf, line, n, string_agg(CASE WHEN k.token IS NULL THEN '<*>' ELSE c.token END, ' ' ORDER BY place) AS template
        FROM cell c LEFT JOIN (SELECT leaf, place, token FROM constant) k USING (leaf, place, token)
        GROUP BY leaf, line, n HAVING count(k.leaf) * 100 >= count(*) * 60
    ), hit AS (
        SELECT leaf, line FROM template JOIN (
            SELECT leaf, template FROM template GROUP BY ALL HAVING sum(n) >= 10
        ) USING (leaf, template)
    ), share AS (
        SELECT doc_id, coalesce(sum(chars) FILTER (WHERE h.line IS NOT NULL), 0) AS recurring, sum(chars) AS chars,
               list(nr) FILTER (WHERE h.line IS NOT NULL) AS places
        FROM t LEFT JOIN hit h USING (leaf, line) GROUP BY doc_id
    ), judged AS (
        SELECT d.doc_id, text, coalesce(recurring > 0 AND recurring * 100 >= chars * 80, false) AS is_copy, places,
               coalesce(recurring > 0, false) AS found
        FROM documents d LEFT JOIN share USING (doc_id)
    ), kept AS (
        SELECT doc_id, is_copy, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
               CAST(CASE WHEN found AND NOT is_copy THEN len(places) ELSE 0 END AS BIGINT) AS n_dropped,
               CASE WHEN found AND NOT is_copy THEN array_to_string(
                   list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(places, i)), chr(10)) ELSE text END AS text
        FROM judged
    )
    SELECT doc_id, n_lines, n_dropped, is_copy, sha256(text) AS text_sha256 FROM kept
    """
)
def op4_line_dedup(spark, sf_dir):
    """Recurring lines dropped from all ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", "is_copy", F.sha2("text", 256).alias("text_sha256"))
