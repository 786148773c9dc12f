import zlib

import numpy as np
import sentencepiece
from helpers import awkward, docs

import corpus_pipeline
from carelens.llm import decontaminate, language, pieces, quality, secrets, simhash

SF_SMALL = "/root/testdata/sf0.001"


def test_held_out_languages_are_found(spark):
    table = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/documents.parquet")
    rows = language.identify(table).join(table.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == table.count()
    held = [r for r in rows if r.held_out and r.lang]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= .97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_filter_returns_exactly_the_languages_plus_false_positives():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 2**62, 30_000, dtype=np.uint64)
    bits = rng.integers(0, 70, 30_000)
    model = language.Model([f"l{i}" for i in range(70)], bits, grams)
    masks = [np.bitwise_and.reduce([model.slots[p][a] for a in model._at(grams)]) for p in range(2)]
    assert all(int(masks[b // 64][i]) >> (b % 64) & 1 for i, b in enumerate(bits.tolist()))
    assert model.false.max() < 1e-6


def test_language_of_awkward_and_empty_tables(spark):
    rows = awkward() + [(30, "the cat and the dog", "en", "s"), (31, "1234 ...", "en", "s"), (32, "der hund", "de", "s")]
    got = language.identify(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 9, 31)) for r in got)
    assert language.identify(docs(spark, rows).limit(0)).count() == 0
    # Nothing to learn from: all unknown.
    assert {r.lang_pred for r in language.identify(docs(spark, [(1, "a b", None, "s")])).collect()} == {"und"}


def test_pipeline_stages_equal_their_operators_and_brute_force(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    text = {r.doc_id: r.text for r in table.collect()}
    kept = {r.doc_id for r in quality.judge(table).collect() if r.kept}
    fp = {i: simhash.fingerprint(text[i]) for i in kept}
    root = {i: i for i in kept}
    find = lambda a: a if root[a] == a else find(root[a])
    for a in kept:
        for b in kept:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {i for i in kept if find(i) == i}
    rows = decontaminate.decontaminate(table.where(table.doc_id.isin(list(kept))), bench).collect()
    kept -= {r.doc_id for r in rows if r.contaminated}
    path = pieces.public_tokenizers.path(pieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert set(got) == kept and len(kept) > 50
    found = {r.doc_id: r for r in secrets.scan_secrets(table.where(table.doc_id.isin(list(kept)))).collect()}
    assert any(r.spans for r in found.values())
    for i, r in got.items():
        masked = secrets._masked(text[i], [(s["first"], s["last"]) for s in found[i].found], "[SECRET]")
        assert r.ids == library.encode(masked) and r.exact


def test_stages_return_the_columns_of_documents(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, SF_SMALL).schema.names == table.schema.names
    docs_ = table.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs_ = stage(spark, docs_, SF_SMALL)
    assert docs_.count() == 0


def test_stages_match_rows_without_id_and_repeated_ids_by_text(spark):
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))
    secret = "password = Zx9Qw8Er7Ty6Ui5"
    good = [prose(90) for _ in range(4)]
    rows = [(None, f"{good[0]} {secret} end"), (None, good[1]), (None, "too short"), (None, None),
            (5, f"{secret} {good[2]}"), (5, good[3]), (6, "short too")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key int, _found int, _bad int, _gone int, _row int"
    table = spark.createDataFrame([(i, t, "en", "s", t and len(t), 1, 2, 3, 4, 5) for i, t in rows], schema)
    bench = spark.createDataFrame([("b", " ".join(good[1].split()[10:40]))], "item_id string, text string")

    masked = secrets.redact(table)
    assert masked.schema.names == table.schema.names
    assert sorted((r.doc_id or 0, r.text or "", r.n_chars) for r in masked.collect()) == sorted(
        (i or 0, (t or "").replace(secret, "[SECRET]"), t and len(t.replace(secret, "[SECRET]"))) for i, t in rows)
    kept = quality.keep_good(table)
    assert sorted(r.text for r in kept.collect()) == sorted(t for _, t in rows if t and len(t) > 50)
    clean = decontaminate.drop_contaminated(kept, bench)
    assert sorted(r.text for r in clean.collect()) == sorted(t for _, t in rows if t and len(t) > 50 and t != good[1])
    assert simhash.keep_one(clean).schema.names == table.schema.names and simhash.keep_one(clean).count() == 3


def test_copies_without_id_and_verdicts_too_many_to_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(6)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))
    good = [prose(90) for _ in range(30)]
    secret = "password = Zx9Qw8Er7Ty6Ui5"
    rows = [(i if i % 3 else None, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(None, good[0], "fr", "s", 1), (None, good[0], "en", "t", 2), (None, good[1], "en", "s", 3), (70, f"x {secret}", "en", "s", 4),
             (71, "short", "en", "s", 5), (None, f"{secret} y", "en", "s", 6), (72, good[4], "en", "s", 7)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    table = spark.createDataFrame(rows, schema).repartition(4)
    bench = spark.createDataFrame([("b", good[7][:200])], "item_id string, text string")

    def stages():
        return [sorted(map(tuple, f.select("doc_id", "text").na.fill(-1).collect())) for f in (
            quality.keep_good(table), simhash.keep_one(table), decontaminate.drop_contaminated(table, bench), secrets.redact(table))]

    want = stages()
    kept = [t for _, t in want[1]]
    assert kept.count(good[0]) == 1 and kept.count(good[1]) == 1 and kept.count(good[4]) == 1 and len(kept) == len(good) + 3
    assert (1, good[1]) in want[1] and (4, good[4]) in want[1]
    assert good[7] not in [t for _, t in want[2]] and not any(secret in t for _, t in want[3]) and len(want[3]) == len(rows)
    from carelens.llm import common
    monkeypatch.setattr(common, "FEW", 0)
    monkeypatch.setattr(secrets, "FEW", 0)
    assert stages() == want
    monkeypatch.setattr(common, "FILTER_BITS", 3)  # nearly every text passes the bitmap
    assert stages() == want


def test_more_languages_than_eight_planes(spark, monkeypatch):
    monkeypatch.setattr(language, "HITS", 2000)
    word = lambda i: "".join(chr(0x4E00 + 3 * i + k) for k in range(3))
    rows = [(f"l{i}", word(i)) for i in range(530)]
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.languages) == 530 and model.planes == 9
    name, score = model.predict([t for _, t in rows] + [None])
    assert name == [x for x, _ in rows] + ["und"] and score[-1] == 0.0 and len(score) == 531
