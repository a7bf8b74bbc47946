"""License scans by diagonal voting, in DataFrame functions only.

Templates are license phrases, notices and whole license texts. All rolling word k-grams of a document (pairs for phrases, triples for texts)
are hashed and joined to the template positions with the same hash and the same words; each match votes for the diagonal word
position minus template position. A phrase stands at a diagonal that has all its pairs, which is an exact match of consecutive
words. For a text, an inserted or missing word shifts what follows it, so diagonals are merged into cells, at most ``SLACK`` of the
template's length to either side, in two overlapping series: whatever lies on diagonals that close shares a cell. A cell
in which ``VOTES`` of the template's positions have voted, each counted once, is verified: the words of the span that votes cover
are aligned with the template by edit distance, and a text is found if ``COVER`` of its words stand there in order. A span is never longer
than the template and its slack, so repeated scraps of a license don't add up to one.

Matches are few and counted map-side; the template side is a fixed table of some thousand rows. A document's results are known by
its id and its text's hash, so a task that runs again gives the same ones, and rows equal in both share them.

Nulls: a null text is empty and has no words. Null or repeated doc_ids and repeated rows each get their own result row. Documents
without words or matches are returned with zero counts, null positions and empty labels. An empty table
gives an empty result. Only id and text are read, so extra columns never clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, text_of
from .license_texts import TEMPLATES

#: What the words of a text are cut at, after A-Z are lower-cased.
CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Templates of up to this many words are phrases, which must match whole; longer ones are texts.
PHRASE = 6
SLACK, VOTES, COVER = 0.2, 0.3, 0.8
#: Longer than any text.
_ALL = 1 << 30


def _templates() -> list[tuple[int, str, bool, list[str], int, int, int]]:
    """(template, label, base, words, words in a gram, grams, slack in words)."""
    out = []
    for k, (label, text, base) in enumerate(TEMPLATES):
        words = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()
        gram = 2 if len(words) <= PHRASE else 3
        out.append((k, label, base, words, gram, len(words) - gram + 1, 0 if gram == 2 else math.ceil(SLACK * len(words))))
    return out


def _letters() -> dict[str, str]:
    """A character of its own for each word of the templates, so that word sequences are strings."""
    return {w: chr(0x4E00 + k) for k, w in enumerate(sorted({w for t in _templates() for w in t[3]}))}


def template_table(spark: SparkSession) -> DataFrame:
    """One row per gram of a template."""
    rows, letter = [], _letters()
    for k, _, _, words, gram, _, slack in _templates():
        for at in range(len(words) - gram + 1):
            third = words[at + 2] if gram == 3 else None
            rows.append((k, at, slack, words[at], words[at + 1], third, "".join(letter[w] for w in words[at : at + gram])))
    table = spark.createDataFrame(rows, "tpl int, at int, slack int, ta string, tb string, tc string, letters string")
    return table.withColumn("th", F.xxhash64("ta", "tb"))


def _facts(spark: SparkSession) -> DataFrame:
    letter = _letters()
    rows = [(k, label, base, gram == 2, len(words), grams, "".join(letter[w] for w in words)) for k, label, base, words, gram, grams, _ in _templates()]
    return spark.createDataFrame(rows, "tpl int, label string, base boolean, phrase boolean, size int, grams int, written string")


def words_of(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, CUT), "")


def _cover() -> Column:
    """Of a text's cell, the share of the template's words that stand in its span in order. The span is longer than the template by twice
    the slack, which costs as many edits and is taken off again."""
    grown = F.flatten(F.transform("seen", lambda s: F.transform(F.sequence(F.lit(0), F.length(s["letters"]) - 1), lambda j: F.struct((s["pos"] + j).alias("p"), F.substring(s["letters"], j + 1, F.lit(1)).alias("x")))))
    by_place = F.map_from_entries(F.array_distinct(grown))
    end = F.col("lo") + F.col("size") + 2 * F.col("slack") - 1
    span = F.get(F.transform(F.array(by_place), lambda m: F.array_join(F.transform(F.sequence("lo", end), lambda p: F.coalesce(F.try_element_at(m, p.cast("int")), F.lit("."))), "")), F.lit(0))
    return F.greatest(F.lit(0.0), 1 - (F.levenshtein(span, "written") - 2 * F.col("slack")) / F.col("size"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The cells that matches fall into: doc_id, text_hash, tpl, label, base, start (first word of the span), found, cover."""
    spark, text = docs.sparkSession, text_of(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))
    shifted = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, _ALL).alias("b"), F.slice("words", 3, _ALL).alias("c"))
    rolled = rows.select("doc_id", "text_hash", F.posexplode(shifted).alias("pos", "gram")).select("doc_id", "text_hash", "pos", "gram.*")
    table = F.broadcast(template_table(spark))
    same = (F.xxhash64("a", "b") == F.col("th")) & (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")) & (F.col("tc").isNull() | (F.col("tc") == F.col("c")))
    diagonal, width = F.col("pos") - F.col("at"), 2 * F.col("slack")
    series = lambda shift: F.floor((diagonal + shift) / width) * width - shift
    cells = F.when(F.col("slack") == 0, F.array(diagonal.cast("long"))).otherwise(F.array_distinct(F.array(series(F.lit(0)).cast("long"), series(F.col("slack")).cast("long"))))
    hits = rolled.join(table, same).select("doc_id", "text_hash", "tpl", "slack", "at", "pos", "letters", F.explode(cells).alias("lo"))
    voted = hits.groupBy("doc_id", "text_hash", "tpl", "slack", "lo").agg(F.size(F.collect_set("at")).alias("votes"), F.collect_set(F.struct("pos", "letters")).alias("seen"))
    voted = voted.join(F.broadcast(_facts(spark)), "tpl")
    whole = (F.col("votes") == F.col("grams")).cast("double")
    cover = F.when(F.col("phrase"), whole).when(F.col("votes") >= VOTES * F.col("grams"), _cover()).otherwise(0.0)
    out = voted.select("doc_id", "text_hash", "tpl", "label", "base", F.col("lo").alias("start"), "phrase", cover.alias("cover"))
    return out.withColumn("found", F.when(F.col("phrase"), F.col("cover") == 1).otherwise(F.col("cover") >= COVER)).drop("phrase")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = text_of(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.size(words_of(text)).cast("long").alias("n_words"))
    is_base = F.col("found") & F.col("base")
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    found = spans(docs, id_col, text_col).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("th")).agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        listed(is_base).alias("base_labels"),
        listed(F.col("found")).alias("labels"),
        F.max("cover").alias("score"),
    )
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")), "left")
    return both.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same results in SQL: phrases by comparing slices of the word list, texts by a word edit distance written out as a fold over lists."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    values = ", ".join(f"({k}, '{label}', {str(base).lower()}, {quoted(words)}, {grams}, {slack})" for k, label, base, words, _, grams, slack in _templates())
    least = "list_append(acc, least(acc[len(acc)] + 1, line[j + 1] + 1, line[j] + CASE WHEN words[j] = w THEN 0 ELSE 1 END))"
    return f"""
        WITH t(tpl, label, base, words, grams, slack) AS (VALUES {values}),
        d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{CUT}'), lambda w: w <> '') AS ws FROM documents),
        p AS (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS a FROM d),
        e AS (SELECT p.doc_id, tpl, label, base, pos AS start, 1.0 AS cover, true AS found
              FROM p JOIN t ON p.a = t.words[1] AND t.slack = 0 JOIN d ON d.doc_id = p.doc_id WHERE d.ws[pos + 1 : pos + len(words)] = words),
        g AS (SELECT tpl, slack, unnest(range(0, grams)) AS off, unnest(list_transform(range(1, grams + 1), lambda i: words[i : i + 2])) AS gram FROM t WHERE slack > 0),
        q AS (SELECT doc_id, pos, [a, lead(a, 1) OVER w, lead(a, 2) OVER w] AS gram FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        h AS (SELECT q.doc_id, q.pos, g.tpl, g.off, g.slack, q.pos - g.off AS diagonal FROM q JOIN g ON q.gram = g.gram),
        c AS (SELECT *, cast(floor(diagonal / (2.0 * slack)) AS BIGINT) * 2 * slack AS lo FROM h UNION SELECT *, cast(floor((diagonal + slack) / (2.0 * slack)) AS BIGINT) * 2 * slack - slack FROM h),
        v AS (SELECT doc_id, tpl, lo, list(DISTINCT pos) AS heads FROM c JOIN t USING (tpl) GROUP BY doc_id, tpl, lo, grams HAVING count(DISTINCT off) >= {VOTES} * grams),
        s AS (SELECT v.doc_id, v.tpl, t.label, t.base, t.words, t.slack, v.lo,
                     list_transform(range(v.lo, v.lo + len(t.words) + 2 * t.slack), lambda i: CASE WHEN list_contains(heads, i) OR list_contains(heads, i - 1) OR list_contains(heads, i - 2) THEN d.ws[i + 1] ELSE '' END) AS span
              FROM v JOIN t ON v.tpl = t.tpl JOIN d ON d.doc_id = v.doc_id),
        l AS (SELECT *, list_reduce(span, lambda line, w: list_reduce(range(1, len(words) + 1), lambda acc, j: {least}, [line[1] + 1]), range(0, len(words) + 1)) AS line FROM s),
        x AS (SELECT doc_id, tpl, label, base, lo AS start, greatest(0.0, 1 - (line[len(line)] - 2 * slack)::DOUBLE / len(words)) AS cover FROM l),
        f AS (SELECT * FROM e UNION ALL SELECT *, cover >= {COVER} FROM x),
        r AS (SELECT doc_id, count(*) FILTER (found AND base) AS n_base, min(start) FILTER (found AND base) AS first_word, max(start) FILTER (found AND base) AS last_word,
                     array_to_string(list_sort(list_distinct(list(label) FILTER (found AND base))), ',') AS base_labels,
                     array_to_string(list_sort(list_distinct(list(label) FILTER (found))), ',') AS labels, max(cover)::DOUBLE AS score FROM f GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(r.n_base, 0) AS n_base, r.first_word, r.last_word,
               coalesce(r.base_labels, '') AS base_labels, coalesce(r.labels, '') AS labels, coalesce(r.score, 0.0)::DOUBLE AS score
        FROM d LEFT JOIN r ON d.doc_id = r.doc_id
    """
