"""Secret scans (operator 3): fixed patterns plus corpus-wide ownership frequency.

The base patterns find assigned secrets, access keys and hex strings.  Beside
them, every long mixed token is a candidate; the hash of each candidate and
base value is aggregated over the corpus by distinct repository and owner.  A
value held by several owners, or by many repositories of one owner (a template
that its author repeats), is a widely copied example; one that stays with a
single owner in few repositories and looks random is a live credential, and is
added to the spans.

Scale: texts are read once into (row, spans, hashes), written to the checkpoint
folder.  Frequencies are map-side combined counts of distinct (value,
repository, owner), so a value copied into a third of all rows is reduced
before it moves; verdicts come back by a join on the value's hash, whose verdict
side has one row per value (AQE splits the other side).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import FEW, chunks, cut, fresh, parted, per_text

# The base patterns and their least lengths, by the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Every run of 16 or more is a match of [0-9a-f]+ that passes, and the reverse.
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "owned")
# Candidates of the method: tokens at least this long, of mixed characters.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_ENTROPY = 3.2
# A value with this many owners, or in this many repositories, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 2, 3
SPAN = "struct<kind:string,first:int,last:int,value:string,live_looking:boolean>"


def live_looking(value: str) -> bool:
    """Digits and letters mixed, with the entropy of a random string."""
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= LEAST_ENTROPY


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret value) of the fixed patterns, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def join_spans(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def scan(text: str | None) -> dict:
    """Base counts and digest, base spans and further candidates of one text."""
    text = text or ""
    base = base_spans(text)
    covered = [(a, b) for _, a, b, _ in base]
    more = [("owned", m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)
            if live_looking(m[0]) and not any(a < m.end() and m.start() < b for a, b in covered)]
    count = Counter(s[0] for s in base)
    return {"n_assign": count["assign"], "n_access": count["access"], "n_hex": count["hex"],
            "base_sha256": hashlib.sha256(join_spans(base).encode()).hexdigest(),
            "_spans": [(k, a, b, hashlib.sha256(v.encode()).hexdigest(), live_looking(v)) for k, a, b, v in base + more]}


def scan_secrets(docs: DataFrame, repository=("source", "lang"), owner: str = "source",
                 example_owners: int = EXAMPLE_OWNERS,
                 example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_examples,
    n_live of every row, and ``found``: array of (kind, first, last, example, live,
    owners, repositories), the last two being the numbers of distinct owners and
    repositories that hold the span's value; live means random-looking and no example.

    ``owner`` is who a text belongs to and ``repository`` the collection within
    (the test documents name only a source: owner = source, repository = source
    and language).  Base spans always stay; ``found`` says of each whether its
    value is a widely copied example.  A null text is empty, a null owner or
    repository counts as one of its own; repeated rows and ids give a result row
    each, with copies in one source having one owner; overlapping spans all
    stay; ties sort by kind; an empty table gives no rows; other columns are not
    read, so clashing names do no harm.
    """
    names = list(dict.fromkeys((*repository, owner)))
    made = {"_doc": "doc_id", **{f"_k{i}": c for i, c in enumerate(names)}}

    def make():
        def run(texts):
            got = [scan(t) for t in texts]
            return {k: [g[k] for g in got] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "_spans")}
        return run

    src = docs.select(*[F.col(c).alias(k) for k, c in made.items()], "text")
    rows = per_text(src, make, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
                    f"_spans array<{SPAN}>", tuple(made))
    # Written once, so that the row number stays the same for both uses.
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    key = {c: f"_k{i}" for i, c in enumerate(names)}
    each = rows.select("_row", *key.values(), F.explode("_spans").alias("s")).select(
        "_row", *key.values(), "s.*")
    text_of = lambda c: F.coalesce(F.col(key[c]).cast("string"), F.lit("\0"))
    held = each.select("value", F.to_json(F.array(*map(text_of, repository))).alias("_repo"),
                       text_of(owner).alias("_owner")).distinct()
    seen = (held.groupBy("value", "_owner").agg(F.count("*").alias("_r"))
            .groupBy("value").agg(F.count("*").alias("owners"), F.sum("_r").alias("repositories")))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    judged = (each.join(seen, "value")
              .withColumn("example", (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories))
              .withColumn("live", F.col("live_looking") & ~F.col("example")).where("kind <> 'owned' OR live"))
    # One row's spans are bounded by its text.
    found = judged.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
        "first", order[F.col("kind")].alias("_o"), "last", "kind", "example", "live", "owners", "repositories"))).alias("_f"))
    rows = rows.drop("_spans", *key.values()).join(found, "_row", "left")
    f = F.coalesce(F.col("_f"), F.from_json(F.lit("[]"), rows.schema["_f"].dataType))
    number = lambda c: F.size(F.filter("found", c)).cast("bigint")
    return (rows.withColumn("_f", f).withColumn("found", F.transform("_f", lambda s: F.struct(
        *[s[c].alias(c) for c in ("kind", "first", "last", "example", "live", "owners", "repositories")])))
        .select(F.col("_doc").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256",
                F.array_join(F.transform("found", lambda s: F.concat_ws(":", s.kind, s["first"], s["last"])), ",").alias("spans"),
                number(lambda s: s.kind == "owned").alias("n_owned"),
                number(lambda s: s.example).alias("n_examples"), number(lambda s: s.live).alias("n_live"), "found"))


def _masked(text: str, spans, mask: str) -> str:
    out, at = [], 0
    for a, b in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], mask]
            at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mask: str = "[SECRET]", examples: bool = True) -> DataFrame:
    """``docs`` with every found span replaced by ``mask`` (overlapping spans by
    one) and n_chars, where there is one, set to the new length.  Base spans whose
    value is a copied example are masked too, since a password copied by many can
    still be a working one; ``examples=False`` leaves those in place.  No row is
    dropped; rows without spans are unchanged.  A row's spans follow from its text
    and the corpus alone, so rows are matched by doc_id and text: repeated ids
    with different texts, and rows without doc_id, are each masked by their own."""
    key, found = fresh("_key", docs), fresh("_found", docs)
    named = F.concat_ws(":", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), F.col("doc_id").cast("string"))
    hits = scan_secrets(docs.withColumn("doc_id", named))
    if not examples:
        hits = hits.withColumn("found", F.filter("found", lambda s: ~s.example))
    hits = (hits.where(F.size("found") > 0).groupBy("doc_id")
            .agg(F.first(F.transform("found", lambda s: F.struct(s["first"], s["last"]))).alias(found))
            .withColumnRenamed("doc_id", key))
    hits = cut(hits)
    if (hits.agg(F.sum(F.size(found) + 1)).first()[0] or 0) <= FEW:
        few = F.broadcast(hits)
        clean, marked = docs.join(few, named == F.col(key), "left_anti"), docs.join(few, named == F.col(key))
    else:
        maybe, never = parted(docs, hits, named, key)
        clean = never.unionByName(maybe.join(hits, named == F.col(key), "left_anti"))
        marked = maybe.join(hits, named == F.col(key))
    marked = marked.select(*docs.columns, found)
    out = T.StructType(docs.schema.fields + [T.StructField(found, T.BooleanType())])
    arrow, at, last = to_arrow_schema(out), docs.columns.index("text"), len(docs.columns)

    def mask_spans(batches):
        # Some megabytes at a time, as Arrow; only texts with spans are rewritten.
        for whole in batches:
            for b in chunks(whole, at):
                spans = b.column(last).to_pylist()
                columns = [b.column(i).cast(arrow.field(i).type) for i in range(last)]
                if any(spans):
                    columns[at] = pa.array(
                        [_masked(t, [tuple(x.values()) for x in s], mask) if s else t
                         for t, s in zip(b.column(at).to_pylist(), spans)], type=arrow.field(at).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array([bool(s) for s in spans])], schema=arrow)

    masked = marked.mapInArrow(mask_spans, out)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col(found), F.length("text").cast(docs.schema["n_chars"].dataType))
                                   .otherwise(F.col("n_chars")))
    return masked.select(*docs.columns).unionByName(clean)
