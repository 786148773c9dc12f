"""Spelling variants by a relational trie frontier (operator 13).

The words of the corpus form a trie that is a table: edges (node, character,
child), a node being the hash of a prefix.  Beside it lies the trie of the words
read backwards.  Two words one edit apart of which one has n letters agree in
their first or in their last n / 2 letters (rounded up or down), so a word searches
the forward trie from the middle of itself on, and the backward trie likewise; near
the roots, where a node has many children, nothing is ever searched.

The frontier holds states (word, position, node, edits).  Unedited states lie on
a word's own path and enter all at once; joined with the edges of their node they
become one-edit states by replacing, inserting or deleting a letter, if the next
letter can follow (an edge knows the letters after it).  These are
joined with the edge table level by level, a letter each; most meet no edge and
end.  A state that reaches the end of its word at the end of another word is a
neighbour.  Where one edit can be placed at several positions (a doubled
letter), only the last is tried.  Node hashes may clash, which only adds states:
every pair found is compared once, as text.

Bounds: a node has at most as many edges as there are letters, so no join emits
all pairs of a group.  States still under way after ``LEVELS`` levels (words of
great length) jump to the node that the rest of their word leads to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, in_batches, stored

# Fixed values of the contract.
RUN = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, TYPO_EVERY, FORM_RATIO = 5, 3, 97, 2
# Levels walked one by one.
LEVELS = 24
# Node hashes: polynomials over a prime field, one start value for each trie.
PRIME, BASE, START = (1 << 61) - 1, 0x1F123BB5_9E3779B9, (17, 23)
PATH = "id bigint, way int, pos int, n int, node bigint, own string, next string, after string, child bigint"
# Stands for the end of a word among the letters that may follow a node.
END = "."


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur often enough; null texts have none, a null
    doc_id counts as empty where its digits would stand."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"), F.explode(F.regexp_extract_all(
        F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least_length)
    h = F.crc32(F.concat("_doc", F.lit(":"), "run"))
    word = F.when(F.col("h") % TYPO_EVERY == 0, F.overlay(
        "run", F.lit(""), (F.col("h") % F.length("run") + 1).cast("int"), F.lit(1))).otherwise(F.col("run"))
    return (runs.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


def word_paths(words: DataFrame) -> DataFrame:
    """PATH of (id, word): each word's nodes from the middle on, forward (way 0) and
    backward (way 1), with the edge it takes there and the two letters after.  Forward
    from the upper middle, backward from the lower: n letters in all."""
    schema = T.StructType.fromDDL(PATH)
    arrow = to_arrow_schema(schema)

    def rows(batches):
        for b in batches:
            for i, word in zip(b.column("id").to_pylist(), b.column("word").to_pylist()):
                n = len(word)
                for way, w in enumerate((word, word[::-1])):
                    node, middle = START[way], (n - 1 - way) // 2
                    for pos, c in enumerate(w):
                        child = (node * BASE + ord(c)) % PRIME
                        if pos >= middle:
                            yield i, way, pos, n, node, c, w[pos + 1:pos + 2] or END, w[pos + 2:pos + 3] or END, child
                        node = child
                    yield i, way, n, n, node, END, END, END, None

    return words.select("id", "word").mapInArrow(lambda batches: in_batches(rows(batches), arrow, 50_000), schema)


def _jumped(states: DataFrame) -> DataFrame:
    """The node that each state's remaining letters lead to."""
    schema = T.StructType.fromDDL("id bigint, way int, node bigint")
    arrow = to_arrow_schema(schema)

    def rows(batches):
        for b in batches:
            for i, way, pos, node, word in zip(*(b.column(c).to_pylist() for c in ("id", "way", "pos", "node", "word"))):
                for c in (word if way == 0 else word[::-1])[pos:]:
                    node = (node * BASE + ord(c)) % PRIME
                yield i, way, node

    return states.select("id", "way", "pos", "node", "word").mapInArrow(lambda b: in_batches(rows(b), arrow), schema)


def neighbours(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(a, b): ids of all ordered pairs of ``words`` (id, word) that differ by
    exactly one inserted, deleted or replaced code point."""
    paths = stored(word_paths(words))
    arcs = stored(paths.groupBy("way", "node", F.col("own").alias("ch")).agg(F.first("child").alias("child")))
    # What may follow an edge: the letters out of its child, in one string.
    out = arcs.groupBy("way", F.col("node").alias("child")).agg(F.array_join(F.collect_set("ch"), "").alias("follow"))
    edges = stored(arcs.where("child IS NOT NULL").join(out, ["way", "child"]))
    # Unedited states, joined with the edges of their node that are not the word's own.
    on = paths.where("pos >= (n + 1 - way) DIV 2")
    met = on.select("id", "way", "pos", "n", "node", "own", "next", "after").join(
        edges, ["way", "node"]).where("ch <> own")
    fits = lambda c: F.contains("follow", F.col(c))
    moves = F.array(F.when((F.col("own") != END) & fits("next"), F.col("pos") + 1),  # replaced
                    F.when(fits("own"), F.col("pos")),                               # inserted
                    F.when((F.col("next") == F.col("ch")) & fits("after"), F.col("pos") + 2))  # deleted, the next matched
    state = ["id", "way", "pos", "n", "node"]
    edited = met.select("id", "way", F.explode(F.array_compact(moves)).alias("pos"), "n", F.col("child").alias("node"))
    last = on.where("pos = n - 1").select("id", "way", F.col("n").alias("pos"), "n", "node")  # the last letter deleted
    edited = stored(edited.union(last))
    ended = [edited.where("pos = n").select("id", "way", "node")]
    frontier = edited.where("pos < n").join(words.select("id", "word"), "id").select(*state, "word")
    for _ in range(levels):
        if frontier.isEmpty():
            break
        letter = lambda i: F.substring(F.col("word"), F.when(F.col("way") == 0, F.col("pos") + 1 + i)
                                       .otherwise(F.col("n") - F.col("pos") - i), F.lit(1))
        step = frontier.withColumns({"ch": letter(0), "_then": F.when(F.col("pos") + 1 < F.col("n"), letter(1)).otherwise(END)}).join(
            edges, ["way", "node", "ch"]).where(F.contains("follow", "_then"))
        frontier = stored(step.select("id", "way", (F.col("pos") + 1).alias("pos"), "n", F.col("child").alias("node"), "word"))
        ended.append(frontier.where("pos = n").select("id", "way", "node"))
        frontier = frontier.where("pos < n")
    else:
        ended.append(_jumped(frontier))
    found = ended[0]
    for more in ended[1:]:
        found = found.union(more)
    terminal = paths.where("pos = n").select("way", "node", F.col("id").alias("b"))
    pairs = found.join(terminal, ["way", "node"]).select(F.col("id").alias("a"), "b").where("a <> b").distinct()
    # Both ways may find a pair, and a hash may have clashed: compare once, as text.
    text = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"_{c}"))
    return pairs.join(text("a"), "a").join(text("b"), "b").where(F.levenshtein("_a", "_b", 1) == 1).select("a", "b")


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends.  Counts at least double with
    each step, so chains are short; every round doubles the steps taken."""
    state = cut(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("_ahead"))
        state = cut(state.join(ahead, "root", "left").select("word", F.coalesce("_ahead", "root").alias("root"),
                                                            F.col("_ahead").isNotNull().alias("_moved")))
        if state.where("_moved").isEmpty():
            return state.drop("_moved")
        state = state.drop("_moved")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    Null and empty texts have no words, and an empty table no rows; repeated rows
    and ids count as often as they occur; a null doc_id is empty in the hash that
    misspells; words of any length are searched; equal counts go to the smallest
    word by code points.  Only doc_id and text are read.
    """
    words = cut(word_counts(docs, least_length, least_count).withColumn("id", F.monotonically_increasing_id()))
    near = neighbours(words).join(words.select(F.col("id").alias("b"), F.col("word").alias("form"), F.col("n").alias("form_n")), "b")
    best = near.groupBy(F.col("a").alias("id")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best"))
    enough = -F.col("best.m") >= FORM_RATIO * F.col("n")
    judged = cut(words.join(best, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")))
    return judged.join(roots(judged.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
