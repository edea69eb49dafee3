"""Spelling variants: words one edit apart, found by merging subtrees of the words' trie with one character changed.

The trie is a table: its nodes are the prefixes of the words, and a node's heavy child is the one that most words pass
through. A word lies in the light subtrees that its path enters by any other child, at most log2 of the number of words,
since the words of a subtree at least halve there. Each light subtree is merged into what stands beside it, small into large:
its words are put at the same node once with the child's character skipped, once with it replaced by the heavy child's, once
behind the heavy child's, and once with it open, where it meets its light siblings. Where terminals coincide, two words are
one edit apart; and as two such words part at one node, by a light child of it or by the end of one word, each pair is found
there exactly once. Merging is a join of whole strings, so no subtree and no node is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored

#: Fixed values of the task: the characters of a run, and the divisor of the checksums of runs that lose a character.
LETTERS, DIVISOR = r"A-Za-zÀ-ÿ", 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for an open character; it is no letter, so no word holds it.
OPEN = "*"
#: Nodes up to this depth are joined without a shuffle; letters are 90 after lower-casing.
TOP = 2


def word_counts(docs: DataFrame, shortest: int, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the lower-cased runs of letters of all whole texts, with the planted deletions, that are long and frequent enough.

    Runs below ``shortest`` can't become words and are left out by the pattern itself.
    """
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.select("id", F.translate("run", UPPER, LOWER).alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    cut = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % DIVISOR == 0, F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))).otherwise(F.col("run"))
    return each.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _head(word: str, length: Column) -> Column:
    return F.substring(word, F.lit(1), length)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): all pairs of different ``word`` values that differ by one inserted, deleted or replaced code point, once each.

    ``words`` holds each word once and is read several times. Work and rows are linear in the words' characters, plus
    four rows for each light subtree a word lies in, plus the pairs themselves.
    """
    path = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    path = path.select("word", "at", _head("word", F.col("at")).alias("node"), F.substring("word", F.col("at") + 1, F.lit(1)).alias("child"))
    children = path.where("child <> ''").groupBy("node", "child").agg(F.count("*").alias("n"))
    heavy = children.groupBy("node").agg(F.max_by("child", F.struct("n", "child")).alias("heavy"))
    # the light children of each word's path, and where it ends above a heavy child
    # (nodes near the root, which many words share, are few: at most 90 ** TOP at the deepest level, so they are broadcast)
    top = path.where(F.col("at") <= TOP).join(F.broadcast(heavy.where(F.length("node") <= TOP)), "node")
    deep = path.where(F.col("at") > TOP).join(heavy.where(F.length("node") > TOP), "node")
    light = top.unionByName(deep).where("child <> heavy").select("word", "node", "child", "heavy", F.substring("word", F.col("at") + 2, F.length("word")).alias("rest"))
    light = stored(light, "light")
    branch = F.col("child") != ""
    put = lambda kind, text, ok: F.when(ok, F.struct(F.lit(kind).alias("kind"), text.alias("text")))
    forms = F.array_compact(F.array(
        put("skip", F.concat("node", "rest"), branch & ~F.startswith("rest", "child")),  # else the two words part further on
        put("replace", F.concat("node", "heavy", "rest"), branch),
        put("insert", F.concat("node", "heavy", "child", "rest"), F.lit(True)),
    ))
    moved = light.select(F.col("word").alias("a"), F.explode(forms).alias("f")).select("a", F.col("f.text").alias("b"))
    met = moved.join(words.select(F.col("word").alias("b")), "b").select("a", "b")
    open_ = light.where(branch).select("word", F.concat("node", F.lit(OPEN), "rest").alias("text"))
    siblings = open_.join(open_.select(F.col("word").alias("other"), "text"), "text").where("word < other").select(F.col("word").alias("a"), F.col("other").alias("b"))
    found = stored(met.union(siblings), "near")
    discard(light)
    return found


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, factor: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of all texts with their near words and the form that each is a variant of.

    Returns word, form (the near word that occurs most, of equal ones the smallest, if it occurs at least ``factor`` times as
    often, else null), root (the end of the chain of forms), n, n_near and form_n. A null or empty text has no words, a null
    id counts as an empty one, repeated rows count each, no rows give no rows, and other columns are not read. Along a chain
    counts grow by ``factor``, so it has fewer than 64 links (for a factor of 2) and six doublings reach every root.
    """
    if factor < 2:
        raise ValueError("the factor must be at least 2")
    words = stored(word_counts(docs, shortest, least, id_col, text_col), "words")
    pairs = near_pairs(words)
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other").join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.m")).alias("other_n"))
    good = F.col("other_n") >= F.col("n") * factor
    rows = stored(rows.select("word", F.when(good, F.col("other")).alias("form"), "n", "n_near", F.when(good, F.col("other_n")).alias("form_n")), "forms")
    chain = rows.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(6):
        after = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(chain.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not longer.where("moved").limit(1).count():
            break
        chain = longer.select("word", "root")
    out = rows.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    discard(words)
    discard(pairs)
    return out
