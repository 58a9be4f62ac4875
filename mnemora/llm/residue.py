"""Template residue, filler and error pages in documents.

Texts are cut into messages (sentences and lines). Code and quoted passages are set aside first: a document
may show such text as its subject. Messages are masked (numbers, words for scripts). Those that hold a word of evidence
(a failure, a demand for scripts, filler, ...) go down a prefix tree of fixed depth: token count, first token, second token;
the others can never be judged residue (see `verdicts`), so they need no template. A node keeps a child of its own
only for tokens with at least 1/CHILDREN of its rows, so a node never has more than CHILDREN children and one for
the rest. In a leaf, a token stays in the template where it is frequent at its place or where a verdict may
rest on it; all others become a wildcard. So a template and each of its members get the same verdict: every template is judged
once, by the fitted classifier of `verdicts`, and the verdict goes to all its messages. Nothing here depends on how many rows a
leaf has, and no step gathers one.

Filler goes the same way: its vocabulary is learnt from the corpus (words that keep company with known filler, in changing
order), its words are marked in the messages, and marked messages are mined and judged like the rest.
Slots that were never filled are looked for in the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm import verdicts
from mnemora.runtime import broadcast_if_small, materialize

#: Most children of a tree node beside the one for rare tokens.
CHILDREN = 100
#: Share of a leaf's rows that keeps a token at its place in the template.
FREQUENT = 0.2
#: Share of a word's messages that hold known filler, and the most that one word may precede it, for a word of filler.
COMPANY, ORDERED = 0.2, 0.5
#: A message stands apart in a paragraph of at most so many sentences.
APART = 2
#: Stands for "an open slot" among a document's messages; no message holds this character.
SLOT = "\u0000slot"
#: Precedes a word that a verdict may rest on.
MARK = "\u0001"

# ---- fixed values ----
SLOTS = (
    r"\{\{[^{}\n]+\}\}",
    r"\{%[^{}\n]+%\}",
    r"[$#]\{[A-Za-z_][\w .]*\}",
    r"<%=?[^%\n]+%>",
    r"\[%[^%\n]+%\]",
    r"<<[A-Za-z][\w .-]*>>",
    r"<[A-Z][A-Z0-9]*(?:[_ -][A-Z0-9]+)+>",
    r"%\([A-Za-z_]\w*\)[sdrf]",
    r"(?<!\w)__[A-Z][A-Z0-9_]+__(?!\w)",
    r"@@[A-Za-z_]{2,}@@",
    r"(?<!\w)%[A-Z][A-Z_]+%(?!\w)",
    r"\[(?i:insert|your|enter|add)\s[^\[\]\n]+\]",
    r"\[[A-Z][A-Z0-9]*(?:[_ ][A-Z0-9]+)+\](?!\()",
    r"<[A-Za-z][\w ]* (?i:goes here)>",
    r"(?<![{$#%\w])\{[A-Za-z_]\w*\}(?!\})",
)
SEEDS = ("lorem", "ipsum")
SCRIPT_WORDS = r"\b(?:java ?script|js|ecmascript|client-side scripts?|scripting|scripts|skripten?)\b"
TAGS = r"(?i)</?(?:html|head|title|meta|link|body|header|footer|nav|main|section|article|h[1-6]|p|div|span|noscript|br|hr|a|b|i|em|strong|ul|ol|li|table|tr|td|th)(?:\s[^<>\n]*)?/?>"
# ---- end of fixed values ----


def _step(df: DataFrame, column: str, marks: str, pattern: str, into: str) -> DataFrame:
    """A replacement in the texts that hold one of the characters it needs. A projection of its own: as one nested expression
    with the next steps, each would be worked out for every mention of it."""
    has = F.contains(column, F.lit(marks[0]))
    for m in marks[1:]:
        has = has | F.contains(column, F.lit(m))
    return df.withColumn(column, F.when(has, F.regexp_replace(column, pattern, into)).otherwise(F.col(column)))


def without_code(df: DataFrame, column: str) -> DataFrame:
    """Fenced and inline code cut out of a column. A fence that is never closed ends at the next blank line, so that it hides no more."""
    df = _step(df, column, "`", r"(?s)```.*?```", "\n")
    df = _step(df, column, "`", r"(?s)```.*?(?:\n[ \t]*\n|\z)", "\n\n")
    return _step(df, column, "`", r"`[^`\n]*`", " code ")


def slots(code_free: str) -> Column:
    """Whether a slot of a template stands in a text that is free of code."""
    has = F.lit(False)
    for m in "{<%_@[":
        has = has | F.contains(code_free, F.lit(m))
    return F.coalesce(has & F.col(code_free).rlike("|".join(SLOTS)), F.lit(False))


def without_markup(df: DataFrame, column: str) -> DataFrame:
    """A column without tags, marks of lists, headings and emphasis, and passages quoted inside a sentence."""
    df = df.withColumn(column, F.translate(column, SLOT[0] + MARK, "  "))
    df = _step(df, column, "<", TAGS, "\n")
    df = _step(df, column, "#>*•|- ", r"(?m)^[\s>#*•|-]+", "")
    df = _step(df, column, "*_", r"(?<=\w|[.,;:!?])[*_]{1,3}(?=\s|$|[.,;:!?])|(?<=\s|^)[*_]{1,3}(?=\w)", "")
    return _step(df, column, '"“', r'(?<=\w )["“][^"”\n]+["”](?= \w|[;,])', "quote")


def paragraphs(df: DataFrame, column: str) -> DataFrame:
    """One row per paragraph. explode() would add a filter that the optimizer pushes below the steps before by repeating them."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode_outer(F.split(column, r"\n[ \t\r]*\n")).alias(column))


def messages(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the sentences and lines of a paragraph, and `apart`: whether it has few sentences. A sentence that runs over lines that begin
    with capitals is there as a whole, too."""
    df = _step(df.withColumn("_j", F.col(column)), "_j", "\n", r"[ \t]*\n[ \t]*", " ")
    df = df.withColumn("_j", F.split("_j", r"(?<=[.!?])\s+")).withColumn("apart", F.size("_j") <= APART)
    lines = F.split(column, r"(?<=[.!?])\s+|[ \t\r]*\n\s*+(?!\p{Ll})")  # a line in lower case goes on with the one before
    df = df.withColumn(out, F.when(F.contains(column, F.lit("\n")), F.concat(lines, "_j")).otherwise(F.col("_j"))).drop("_j")
    return df.withColumn(out, F.filter(F.array_distinct(F.transform(out, F.trim)), lambda m: m != ""))


def mask(df: DataFrame, column: str) -> DataFrame:
    """Turns the messages of a column into their forms: lower case, single blanks, words for scripts as `jscript`, digits as 0, without marks at
    the end. Each step is a projection of its own, see `_step`."""
    df = df.withColumn(column, F.lower(column))
    df = df.withColumn(column, F.when(F.col(column).rlike(r"\s\s|[\t\n\u00a0]"), F.regexp_replace(column, r"[\s\u00a0]+", " ")).otherwise(F.col(column)))
    has = F.contains(column, F.lit("script")) | F.contains(column, F.lit("skript")) | F.contains(column, F.lit("js"))
    named = F.regexp_replace(F.regexp_replace(column, SCRIPT_WORDS, "jscript"), r"\bjscript[^\s\w]+", "jscript")
    df = df.withColumn(column, F.when(has, named).otherwise(F.col(column)))
    return df.withColumn(column, F.when(F.col(column) == SLOT, SLOT).otherwise(F.regexp_replace(F.rtrim(column, F.lit(" .!?…")), r"\d+", "0")))


def _begins(concepts: tuple[str, ...] | None = None) -> str:
    return rf"(?<![\p{{L}}\p{{N}}_]){verdicts.stem_pattern(concepts)}"


def evidence(form: Column) -> Column:
    """Whether a form holds a word that a bad verdict needs; true for some others, never false for one of these."""
    firsts, seconds = (tuple(dict.fromkeys(x)) for x in zip(*verdicts.PAIRED, strict=True))
    return form.rlike(_begins(verdicts.EVIDENCE)) | (form.rlike(_begins(firsts)) & form.rlike(_begins(seconds)))


def _words(form: str | Column) -> Column:
    return F.split(F.trim(F.regexp_replace(form, r"[^\p{L}]+", " ")), " ")


def filler_in(said: DataFrame) -> DataFrame:
    """Forms with words of filler: `form`, `filler` (those words).

    A word of filler keeps company with a seed word in at least COMPANY of its messages, and no single word precedes it in more
    than ORDERED of them: in a sentence about filler, each word has its one place.
    """
    seeded = said.where(F.contains("form", F.lit(SEEDS[0])) | F.contains("form", F.lit(SEEDS[1]))).select(_words("form").alias("w")).where(F.arrays_overlap("w", F.array(*map(F.lit, SEEDS))))
    each = seeded.select("w", F.posexplode("w").alias("i", "word")).select("word", F.when(F.col("i") > 0, F.element_at("w", F.col("i"))).alias("prior"))
    known = each.groupBy("word", "prior").agg(F.count(F.lit(1)).alias("n")).groupBy("word").agg(F.sum("n").alias("seeded"), F.max("n").alias("top"))
    known = materialize(known.where(F.col("top") <= ORDERED * F.col("seeded")), "company")
    spoken = said.select("form", F.explode(F.array_distinct(_words("form"))).alias("word")).join(broadcast_if_small(known), "word")
    spoken = materialize(spoken.groupBy("form", "word", "seeded").agg(F.count(F.lit(1)).alias("n")), "spoken")
    total = spoken.groupBy("word").agg((F.first("seeded") >= COMPANY * F.sum("n")).alias("is")).where("is").select("word")
    return spoken.join(broadcast_if_small(total), "word").groupBy("form").agg(F.collect_set("word").alias("filler"))


def mine_templates(forms: DataFrame) -> DataFrame:
    """Template of every distinct form: `form`, `template`, `rows`, `apart`. `forms` has `form`, `tokens`, `rows` and `apart` (how many of them)."""
    # the words a verdict may rest on get a mark, by one expression over the whole form: inside a lambda, a pattern of this length is decoded for every word
    telling = rf"(?<![^ ])(?=0:*(?: |$)|[^\p{{L}}\p{{N}}< ]*<?/?{verdicts.stem_pattern()})"
    forms = materialize(forms.withColumn("tokens", F.split(F.regexp_replace(F.array_join("tokens", " "), telling, MARK), " ")), "forms")
    tree = forms.withColumn("n", F.size("tokens")).withColumn("t1", F.col("tokens")[0]).withColumn("t2", F.coalesce(F.get("tokens", F.lit(1)), F.lit("")))
    for keys, token, kept in ((["n"], "t1", "k1"), (["n", "k1"], "t2", "k2")):
        parent = tree.groupBy(*keys).agg(F.sum("rows").alias("all"))
        child = tree.groupBy(*keys, token).agg(F.sum("rows").alias("own"))
        own = child.join(broadcast_if_small(parent), keys).where(F.col("own") * CHILDREN >= F.col("all")).select(*keys, token, F.col(token).alias(kept))
        tree = tree.join(broadcast_if_small(own), [*keys, token], "left").withColumn(kept, F.coalesce(kept, F.lit(verdicts.WILDCARD)))
    leaf = ["n", "k1", "k2"]
    tree = materialize(tree.select("form", "tokens", "rows", "apart", *leaf), "tree")
    size = tree.groupBy(*leaf).agg(F.sum("rows").alias("all"))
    placed = tree.select(*leaf, "rows", F.posexplode("tokens").alias("at", "token")).groupBy(*leaf, "at", "token").agg(F.sum("rows").alias("own"))
    often = placed.join(broadcast_if_small(size), leaf).groupBy(*leaf, "at").agg(F.collect_list(F.when(F.col("own") >= FREQUENT * F.col("all"), F.col("token"))).alias("stay"))
    often = often.groupBy(*leaf).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "stay"))), lambda x: x["stay"]).alias("stay"))
    fixed = F.transform("tokens", lambda t, i: F.when(F.startswith(t, F.lit(MARK)) | F.array_contains(F.get("stay", i), t), t).otherwise(F.lit(verdicts.WILDCARD)))
    return tree.join(broadcast_if_small(often), leaf).select("form", F.translate(F.array_join(fixed, " "), MARK, "").alias("template"), "rows", "apart")


def judge(weights: dict[str, float]):
    """Pandas UDF: `message`, `filler` or null for templates and the share of their rows that stand apart."""

    @F.pandas_udf("string")
    def kind(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for template, apart in parts:
            bad = [verdicts.score(t, a, weights) > 0 for t, a in zip(template, apart, strict=True)]
            yield pd.Series([("filler" if verdicts.is_filling(t) else "message") if b else None for t, b in zip(template, bad, strict=True)], dtype=object)

    return kind


def find_residue(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents with residue: `doc_id`, `kinds` (slot, message, filler).

    One row per id, whatever number of rows holds it. Null ids, null and empty texts give no row. Empty tables give
    none. Other columns are not read. Texts are read whole, sentences of any length.
    """
    docs = without_code(documents.select(F.col(doc_id).alias("d"), F.col(text).alias("c")).where("d is not null and c is not null"), "c")
    docs = without_markup(docs.withColumn("slot", slots("c")), "c")
    docs = messages(paragraphs(docs, "c"), "c", "m").drop("c")
    docs = docs.withColumn("m", F.when(F.col("slot"), F.array_prepend("m", F.lit(SLOT))).otherwise(F.col("m")))
    said = docs.select("d", "apart", F.explode_outer("m").alias("m")).where("m is not null")
    said = mask(said.withColumnRenamed("m", "form"), "form")
    said = materialize(said.withColumn("tells", (F.col("form") != SLOT) & evidence(F.col("form"))), "messages")
    filler = materialize(filler_in(said.where(F.col("form") != SLOT)), "filler")
    told = said.join(broadcast_if_small(filler), "form", "left").where("tells or filler is not null")
    marks = F.transform(F.split("form", " "), lambda t: F.when(F.array_contains("filler", F.regexp_replace(t, r"[^\p{L}]+", "")), "<filler>").otherwise(t))
    forms = told.groupBy("form").agg(F.first("filler", True).alias("filler"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("apart").cast("int")).alias("apart"))
    forms = forms.select("form", F.when(F.col("filler").isNotNull(), marks).otherwise(F.split("form", " ")).alias("tokens"), "rows", "apart")
    mined = materialize(mine_templates(forms), "templates")
    templates = mined.groupBy("template").agg((F.sum("apart") / F.sum("rows")).alias("apart"))
    judged = templates.select("template", judge(verdicts.weights())("template", "apart").alias("kind")).where("kind is not null")
    bad = materialize(mined.join(broadcast_if_small(materialize(judged, "verdicts")), "template").select("form", "kind"), "bad")
    hits = said.select("d", "form").join(broadcast_if_small(bad), "form").select("d", "kind").unionByName(said.where(F.col("form") == SLOT).select("d", F.lit("slot").alias("kind")))
    return hits.groupBy("d").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).withColumnRenamed("d", doc_id)
