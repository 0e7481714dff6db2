"""The training-data operators against brute force, round trips and odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelloom.llm import chat, common, components, decontamination, jaccard_join, licenses, line_spread, mixing, quality_model, quality_rules, queries, secrets, token_shards

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word" + " lorem ipsum dolor sit amet" * 8000
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, LONG, "en", "b", 9), (None, "x y z", None, "a", None), (4, "same text here", "en", "a", 1), (4, "same text here", "en", "a", 1), (5, " \n\t ", "en", "", 3), (6, "é" * 50 + " <|endoftext|> \0 tail", "fr", "c", 1)]
BPE = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with the names that operators use inside."""
    df = docs(spark, ODD)
    for name in ("size", "score", "label", "rid", "key", "taken", "spans", "n_cut", "hits", "doc", "fold", "y", "x", "failed_rule", "rep", "n"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


# --- 2 -----------------------------------------------------------------------------


def test_shards_hold_the_librarys_ids_in_order(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    got = token_shards.token_output(odd, BPE).orderBy("start").collect()
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for g, r in zip(got, rows, strict=True):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        assert (g["doc_id"], g["start"], g["n_tokens"]) == (r[0], at, len(ids))
        assert g["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert token_shards.token_output(none, BPE).count() == 0


def test_encoder_equals_the_library_on_odd_white_space():
    from tokenizers import Tokenizer

    t, mine, rng = Tokenizer.from_file(BPE), token_shards.Encoder(BPE), random.Random(1)
    texts = ["".join(rng.choice(" \n\tab,.1'é\xa0s\x1cñ") for _ in range(rng.randrange(40))) for _ in range(2000)] + ["it's  don't\r\n", "\n", " a", "a \n\nb c"]
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_lookup_reads_wanted_documents_and_broken_frames_are_noticed(spark, tmp_path):
    df = docs(spark, [(k, f"text number {k} " * (k % 7)) for k in range(300)])
    manifest = token_shards.write_shards(df, f"file://{tmp_path}/s", BPE)
    got = {r["doc_id"]: r["ids"] for r in token_shards.lookup(manifest, df.where("doc_id in (3, 250)")).collect()}
    whole = token_shards.Encoder(BPE).encode([f"text number {k} " * (k % 7) for k in (3, 250)])
    assert [got[3], got[250]] == [[*np.frombuffer(x, "<u4").tolist(), 0] for x in whole]
    path = manifest.first()["path"].removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="checksum|zstd|ZstdError|corrupt"):
        token_shards.read_shards(manifest).collect()


def test_added_tokens_get_the_librarys_default_ids(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    t, texts = Tokenizer.from_file(BPE), ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n\n  y\t", "<|endoftext", "plain text"]
    for text, ids in zip(texts, token_shards.Encoder(BPE).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["tokens"]
    for got in (token_shards.op2_token_binary(spark, str(tmp_path)), stage(spark, odd, str(tmp_path))):
        at = 0
        for g, r in zip(got.orderBy("start").collect(), sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
            ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
            assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r[0], at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
            at += len(ids)


# --- 3 -----------------------------------------------------------------------------


@pytest.mark.parametrize("max_set", [decontamination.MAX_SET, 0])
def test_contamination_of_odd_and_planted_texts(spark, odd, none, max_set):
    item = "One two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item), (2, "short ITEM"), (3, None), (4, "..."), (None, "ghost item")], "item_id long, text string").withColumn("hits", F.lit(1))
    df = odd.unionByName(docs(spark, [(20, "zero " + item.lower() + " tail short item"), (21, "two three four five six seven eight nine ten eleven"), (22, "a ghost item")]), allowMissingColumns=True)
    got = {r["doc_id"]: r for r in decontamination.contamination(df, bench, max_set=max_set).collect()}
    assert (got[20]["n_hit"], got[20]["n_items"], got[20]["items_sha256"]) == (14, 2, hashlib.sha256(b"1,2").hexdigest())
    assert (got[21]["n_hit"], got[21]["n_items"]) == (10, 1) and (got[22]["n_hit"], got[22]["n_items"]) == (2, 0)
    assert got[1]["n_words"] == 0 and not got[1]["contaminated"] and not got[3]["contaminated"]
    kept = decontamination.decontaminate(df, bench, max_set=max_set)
    assert kept.columns == df.columns and kept.count() == df.count() - 3
    assert decontamination.contamination(none, bench, max_set=max_set).count() == 0
    assert decontamination.contamination(odd, bench.limit(0), max_set=max_set).where("contaminated").count() == 0


def test_spans_are_cut(spark):
    bench = spark.createDataFrame([(1, "short item")], "item_id long, text string")
    df = docs(spark, [(1, "A short, ITEM of text"), (2, "clean text"), (3, None)])
    assert [r["text"] for r in decontamination.decontaminate(df, bench, "span").orderBy("doc_id").collect()] == ["A of text", "clean text", None]


@pytest.mark.parametrize("max_set", [decontamination.MAX_SET, 0])
def test_each_row_is_decided_by_itself(spark, odd, max_set):
    bench = spark.createDataFrame([(1, "short item"), (2, "leaked")], "item_id long, text string")
    df = odd.unionByName(docs(spark, [(None, "null id, short ITEM."), (7, "A short, ITEM of text"), (7, "clean twin"), (8, "all leaked short item"), (8, "all leaked short item"), (9, "item short")]), allowMissingColumns=True)
    told = lambda x: sorted(((r["doc_id"], r["text"]) for r in x.collect()), key=str)
    clean = [(r[0], r[1]) for r in ODD] + [(7, "clean twin"), (9, "item short")]
    kept = decontamination.decontaminate(df, bench, max_set=max_set)
    cut = decontamination.decontaminate(df, bench, "span", max_set=max_set)
    assert told(kept) == sorted(clean, key=str) and kept.columns == cut.columns == df.columns
    assert told(cut) == sorted([*clean, (None, "null id."), (7, "A of text"), (8, "all"), (8, "all")], key=str)
    assert {r["size"] for r in cut.where("doc_id = 3").collect()} == {"clash"}


# --- 4 -----------------------------------------------------------------------------


def test_sainte_lague_equals_dealing_one_by_one():
    rng = random.Random(4)
    for _ in range(200):
        votes = [rng.choice([0, 1, 2, 5, rng.random() * 50]) for _ in range(rng.randrange(1, 8))]
        caps = [rng.randrange(0, 30) for _ in votes]
        seats, got = rng.randrange(0, 60), [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i in range(len(votes)) if votes[i] > 0 and got[i] < caps[i]]
            if not open_:
                break
            got[max(open_, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
        assert mixing.sainte_lague(votes, seats, caps) == got


def test_mix_meets_targets_and_bounds(spark, odd, none):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 400)), "en", rng.choice(["big"] * 6 + ["b", "c", None, "tiny"]) if k else "tiny") for k in range(600)]
    got = mixing.mix(mixing.measured(docs(spark, rows), ["doc_id", "source"]))
    again = mixing.mix(mixing.measured(docs(spark, rows[::-1]).repartition(7), ["doc_id", "source"]))
    pick = lambda df: sorted((r["doc"]["doc_id"], r["taken"]) for r in df.collect())
    assert pick(got) == pick(again)
    by = defaultdict(list)
    for r in got.collect():
        assert 0 <= r["taken"] <= 3 * r["size"] and sum(s["end"] - s["start"] for s in r["spans"]) == r["taken"]
        by[r["doc"]["source"]].append(r)
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])
    for s, t in zip(order, want, strict=True):
        assert abs(by[s][0]["target"] - t) < 1e-6 and abs(sum(r["taken"] for r in by[s]) - t) <= 2 * mixing.BLOCK + 0.001 * t
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(mixing.measured(none, ["doc_id"])).count() == 0


def test_mix_of_many_sources_and_shards_is_the_same(spark, monkeypatch):
    rng = random.Random(15)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 90)), "en", rng.choice(["big"] * 30 + [None] + [f"s{j}" for j in range(40)])) for k in range(900)]
    pick = lambda: sorted((r["doc"]["doc_id"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix(mixing.measured(docs(spark, rows), ["doc_id"])).collect())
    monkeypatch.setattr(mixing, "SHARD_WORDS", 64)
    small = pick()
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 3)  # the plan is made by aggregations
    assert pick() == small
    monkeypatch.setattr(mixing, "FAN", 16)  # quotas are dealt in levels
    deep = pick()
    assert [r[:3] for r in deep] == [r[:3] for r in small] and abs(sum(r[3] for r in deep) - sum(r[3] for r in small)) <= 16 * 60


def test_targets_stop_at_three_times_the_size():
    assert mixing.targets([10, 1000, 1000], [5, 2, 1]) == [30.0, 1980 * 2 / 3, 1980 / 3]
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]


# --- 5 -----------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 8)  # several nodes to a child of the root
    monkeypatch.setattr(jaccard_join, "HOT", 4)  # and a second order of the shingles
    rng, rows = random.Random(6), []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 12, 80, 300]))]
        for _ in range(rng.randrange(1, 18)):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 20))):
                own[rng.randrange(len(own))] = f"n{rng.randrange(400)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, rows[0][1].upper())]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_few_heads_go_on_to_the_join_that_tells_who_meets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    shared = rng.integers(-(2**63), 2**63 - 1, 40)
    heads = [[int(shared[k % 40]), *map(int, rng.integers(-(2**63), 2**63 - 1, 30))] for k in range(200)]
    reps = spark.createDataFrame(list(enumerate(heads)), "rep long, head array<long>")
    keys = spark.createDataFrame([(int(k),) for k in shared], "key long")
    got = {tuple(r) for r in jaccard_join.may_meet(reps, keys).collect()}
    assert {(k, h[0]) for k, h in enumerate(heads)} <= got <= {(k, x) for k, h in enumerate(heads) for x in h} and len(got) < 210
    told = {}
    for rows in (jaccard_join.BROADCAST_ROWS, 0):  # 0: through the map of bits
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", rows)
        words = [" ".join(f"w{(k // 4) * 50 + j}" for j in range(40)) + f" tail{k}" for k in range(60)]
        told[rows] = sorted(map(tuple, jaccard_join.jaccard_components(docs(spark, [(k, w) for k, w in enumerate(words)])).collect()))
    assert len(set(map(str, told.values()))) == 1 and {c for _, _, c in told[0]} == set(range(0, 60, 4))


def test_signature_trees_find_every_similar_pair():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, (6, 200), dtype=np.uint64)
    tokens = [np.unique(np.where(rng.random(200) < 0.06, rng.integers(0, 1 << 63, 200, dtype=np.uint64), base[k % 6])) for k in range(150)]
    sig = np.stack([jaccard_join.bitmap(t).view(np.uint64) for t in tokens])
    n, label = np.array([len(t) for t in tokens]), np.arange(150)
    whole, left, right = (jaccard_join.Tree(label[x], n[x], sig[x], 2) for x in (slice(0, 150), slice(0, 60), slice(60, 150)))
    told = lambda a, b, at: {(int(x), int(y) + at) for i, j in jaccard_join.tree_pairs(a, b) for x, y in zip(i, j, strict=True)}
    found, across = told(whole, whole, 0), told(left, right, 60)
    i, j, whole_of_it = jaccard_join.joining_pairs(label, n, sig)
    joined = list(zip(i.tolist(), j.tolist(), strict=True))
    assert not whole_of_it and jaccard_join.joining_pairs(label[:2], n[:2], sig[:2])[2]
    for a in range(150):
        for b in range(a + 1, 150):
            if jaccard_join.enough(len(np.intersect1d(tokens[a], tokens[b])), len(tokens[a]), len(tokens[b])):
                assert (a, b) in found and ((a, b) in across or not a < 60 <= b)
                assert len(np.intersect1d(jaccard_join.head(tokens[a]), jaccard_join.head(tokens[b])))
    assert len(joined) < 150 and set(map(lambda p: (min(p), max(p)), joined)) <= found


def test_similar_sets_share_a_shingle_of_their_heads_in_any_order():
    rng = np.random.default_rng(8)
    for _ in range(300):
        size = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + size // 8)), dtype=np.uint64)]))
        if len(b) and jaccard_join.enough(len(np.intersect1d(a, b)), len(a), len(b)):
            hot = np.sort(rng.choice(np.union1d(a, b), int(rng.integers(0, len(a) + 1)), replace=False)) if len(a) > 1 else None
            assert len(np.intersect1d(jaccard_join.head(a, hot), jaccard_join.head(b, hot)))


def test_join_of_odd_rows(spark, odd, none):
    got = jaccard_join.jaccard_components(odd)
    assert got.count() == len(ODD)
    by = {r["doc_id"]: r for r in got.collect()}
    assert (by[1]["n_shingles"], by[1]["component_id"]) == (0, 1) and by[4]["component_id"] == 4 and by[None]["component_id"] is None
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert jaccard_join.jaccard_components(none).count() == 0


def test_long_chains_are_one_component(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["label"] for r in components.components(links).collect()} == {0}


# --- 6 -----------------------------------------------------------------------------


def test_chat_examples_and_masks(spark):
    rows = [(1, 0, "system", "be <s> brief\\"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "yes</s>"), (1, 3, "user", None), (1, 4, "assistant", "no\n"), (1, 5, "user", "bye"), (2, 0, "user", "x"), (None, 0, None, "y"), (3, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1)).withColumn("t", F.lit(1))
    made = chat.examples(df)
    one = made.where("conv_id = 1").orderBy("example").collect()
    assert [r["target"] for r in one] == [True, True, False]
    assert [r["text"][r["loss_start"] - 1 :][: r["loss_length"]] for r in one] == ["yes<\\/s>\\", "no\n", ""]
    assert one[1]["text"].startswith(one[0]["text"]) and "[INST]" not in one[2]["text"]
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    told = "".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert back[1]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest() and back[1]["loss_sha256"] == hashlib.sha256(b"yes</s>no\n").hexdigest()
    assert back[2]["loss_chars"] == 0 and back[None]["n_turns"] == 1 and back[3]["n_turns"] == 1
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


# --- 8 -----------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    got = quality_model.op8_quality_classifier(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_classifier_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (6, 1, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").withColumn("fold", F.lit(1))
    model = quality_model.fit(odd, labels)
    assert quality_model.scored(odd, model).where("score between 0 and 1").count() == len(ODD)
    assert quality_model.fit(odd, labels.limit(0)) is None and quality_model.fit(none, labels) is None
    assert {r["score"] for r in quality_model.scored(odd, None).collect()} == {0.5}
    assert quality_model.accepted(odd, labels).columns == odd.columns


def test_isotonic_pools_violators():
    assert quality_model.isotonic(np.array([1.0, 0, 2]), np.array([2.0, 2, 2])).tolist() == [0.25, 0.25, 1.0]


# --- 9 -----------------------------------------------------------------------------


def brute_statistics(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for k in range(len(w) - 2):
        at[tuple(w[k : k + 3])].append(k)
    repeated = {p + j for v in at.values() if len(v) > 1 for p in v for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_statistics_equal_brute_force(spark, odd, none):
    rng = random.Random(9)
    texts = [None, "", "a a a", "a a a a", " \n \n", "x y z\nx y z\n|$", LONG] + ["".join(rng.choice("ab \n#") for _ in range(60)) for _ in range(40)]
    got = quality_rules.statistics(docs(spark, list(enumerate(texts)))).collect()
    for r in got:
        assert tuple(r)[1:] == brute_statistics(texts[r["doc_id"]])
    assert quality_rules.cascade(odd).where("failed_rule is null").count() == 0
    assert quality_rules.cascade(none).count() == 0


def test_a_rejected_row_is_given_to_no_later_rule(spark):
    first = quality_rules.Rule(("n_words",), lambda s: s("n_words") < 3)
    second = quality_rules.Rule(("n_symbols",), lambda s: F.when(s("n_words") < 3, F.raise_error(F.lit("evaluated"))).otherwise(s("n_symbols") > 0))
    df = docs(spark, [(1, "a b"), (2, "a b c #"), (3, "a b c d"), (4, None)])
    judged = quality_rules.cascade(df, ["first", "second"], {"first": first, "second": second})
    assert {r["doc_id"]: r["failed_rule"] for r in judged.collect()} == {1: "first", 2: "second", 3: None, 4: "first"}
    assert [tuple(r) for r in quality_rules.evaluated(judged, ["first", "second"]).collect()] == [("first", 4, 2), ("second", 2, 1)]
    with pytest.raises(Exception, match="evaluated"):
        quality_rules.cascade(df, ["second", "first"], {"first": first, "second": second}).collect()


def test_rules_are_ordered_by_rejection_per_cost_and_reruns_agree(spark):
    rows = [(k, ("* x\n" * 60 if k % 2 else "word and other things " * 30) + ("12 34 " * 200 if k % 10 == 0 else "")) for k in range(60)]
    df = docs(spark, rows)
    order = quality_rules.order_rules(df)
    assert order == quality_rules.order_rules(df) and sorted(order) == sorted(quality_rules.RULES)
    told = [sorted((r["doc_id"], r["failed_rule"] or "") for r in quality_rules.cascade(df).collect()) for _ in range(2)]
    assert told[0] == told[1]
    brute = {k: quality_rules.cascade(df, [k]).where("failed_rule is not null").count() for k in quality_rules.RULES}
    assert brute[order[0]] == max(v for k, v in brute.items() if k != "repeated")
    texts = ["... \n..\n\u2026\n....", "- a\n * b\n\u2022c\nd - e", "1 2a 3- \u00e9 \n--\n", "", None]
    got = docs(spark, list(enumerate(texts))).select("doc_id", *[f(F.col("text")).alias(k) for k, f in quality_rules.STATISTICS.items() if k not in quality_rules.BASE_STATISTICS]).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == [(3, 4, 0, 3), (3, 4, 3, 0), (3, 2, 1, 0), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_order_changes_no_verdict(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = [{r["doc_id"] for r in quality_rules.cascade(df, order).where("failed_rule is null").collect()} for order in (list(quality_rules.RULES), list(quality_rules.RULES)[::-1])]
    assert kept[0] == kept[1] and kept[0]


# --- 1, 7, 10 ----------------------------------------------------------------------


def test_secrets_are_told_from_look_alikes(spark, odd, none):
    rng = random.Random(11)
    made = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    alnum, hexes, word = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", lambda: made("aeioulnrstdm", 7)
    secret = [lambda: f"then AKIA{made(alnum[26:], 16)} came", lambda: f"GITHUB_TOKEN=ghp_{made(alnum, 36)}", lambda: f"header eyJ{made(alnum, 17)}.eyJ{made(alnum, 33)}.{made(alnum, 43)}", lambda: f'lorem token = "{made(hexes, 40)}" ipsum', lambda: f"DB_PASSWORD: {made(alnum, 14)} end"]
    plain = [lambda: f"see commit {made(hexes, 40)} and more", lambda: f"file /opt/{word()}/{word()}/{word()}.py is", lambda: f"mail {word()}.{word()}@{word()}.org to", lambda: f"of {word()}{word()}{word()} it", lambda: f"sha256 {made(hexes, 64)} sum", lambda: f"at https://{word()}.com/{word()}/{word()}"]
    forms = [*secret, *plain]
    rows = [(k, " ".join(word() for _ in range(9)) + " " + forms[k % len(forms)]()) for k in range(880)]
    # The corpus alone has one form of credential; the others are judged by what the examples taught.
    corpus = docs(spark, [r for r in rows if r[0] % len(forms) in (3, 5, 6, 7, 8, 9, 10)])
    dictionary = secrets.Dictionary(corpus)
    known = secrets.candidates(corpus).unionByName(secrets.candidates(secrets.example_findings(spark)))
    model = secrets.fit(secrets.featured(secrets.labelled_findings(known), dictionary))
    held = docs(spark, [(k, " ".join(word() for _ in range(9)) + " " + forms[k % len(forms)]()) for k in range(440)])
    told = {r["doc_id"] for r in secrets.scan(secrets.featured(secrets.candidates(held), dictionary), model).where("is_secret").collect()}
    by = {f: sum(k in told for k in range(f, 440, len(forms))) / 40 for f in range(len(forms))}
    assert all(by[f] >= 0.9 for f in range(len(secret))) and all(by[f] <= 0.1 for f in range(len(secret), len(forms))), by
    found = secrets.secret_scan(held)
    assert found.where("is_secret").select("doc_id").distinct().count() >= 180
    joined = "-" * 20 + "é" + "a" * 16 + '":"' + "b" * 20 + '",x@' + "c" * 15
    assert [(r["run"], r["value"]) for r in secrets.candidates(docs(spark, [(1, joined)])).orderBy("run").collect()] == [(0, "-" * 20), (1, "a" * 16), (2, "b" * 20)]
    short = docs(spark, [(1, 'password = "hunter2hunter" pin'), (2, "pwd=a1b2c3d4e5"), (3, "word = a1b2c3d4e5")])
    assert {r["doc_id"]: r["value"] for r in secrets.candidates(short).collect()} == {1: "hunter2hunter", 2: "a1b2c3d4e5"}
    few = secrets.featured(secrets.candidates(odd), secrets.Dictionary(None))
    assert secrets.fit(few.withColumn("label", F.lit(0.0))) is None and secrets.scan(few, None).where("not is_secret").count() == 0
    assert secrets.candidates(none).count() == 0 and secrets.secret_scan(none).count() == 0 and secrets.secret_scan(odd).count() == few.count()
    assert spark.range(1).select(secrets.redacted(F.lit("a key b"), F.array(F.lit("key")))).first()[0] == "a <SECRET> b"


def test_boilerplate_lines_go_and_near_threshold_ones_are_exact(spark, odd, none):
    line = "All rights of this site are reserved here."
    rows = [(k, f"own line number {k} of this text\n{line}\n" + ("this line stands on seven sites" if k < 7 else ""), "en", f"s{k}") for k in range(30)]
    got = {r["doc_id"]: r for r in line_spread.without_boilerplate(docs(spark, rows)).collect()}
    assert all(r["n_cut"] == 1 and line not in r["text"] for r in got.values()) and "seven sites" in got[0]["text"]
    assert line_spread.boilerplate(docs(spark, rows[:8])).first()["exact"]
    out = line_spread.without_boilerplate(odd)
    assert out.count() == len(ODD) and {r["text"] for r in out.collect()} == {r[1] for r in ODD}
    assert line_spread.without_boilerplate(none).count() == 0


def test_short_boilerplate_lines_go_too(spark, monkeypatch):
    rows = [(k, f"Of, edti oner.\nown {k}\n\n \t\nEnd." + ("\nSeven." if k < 7 else ""), "en", f"s{k}") for k in range(30)]
    got = {r["doc_id"]: r for r in line_spread.without_boilerplate(docs(spark, rows)).collect()}
    assert all((r["n_cut"], r["text"]) == (2, f"own {k}\n\n \t" + ("\nSeven." if k < 7 else "")) for k, r in got.items())
    assert line_spread.without_boilerplate(docs(spark, rows), least=20).where("n_cut > 0").count() == 0
    monkeypatch.setattr(line_spread, "sized", lambda df: df.hint("merge"))
    again = {r["doc_id"]: (r["n_cut"], r["text"]) for r in line_spread.without_boilerplate(docs(spark, rows)).collect()}
    assert again == {k: (r["n_cut"], r["text"]) for k, r in got.items()}


def test_licences_are_confirmed_by_wording(spark, odd, none):
    text = "intro\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 2.\nthe driver's licence was lost in the warranty office today"
    got = licenses.license_scan(docs(spark, [(1, text)])).orderBy("line").collect()
    assert [(r["license"], r["confirmed"]) for r in got[:2]] == [("Apache-2.0", True), ("MIT", True)]
    assert got[2]["license"] == "GPL-3.0" and '"3"' in got[2]["differences"] and not got[3]["confirmed"]
    assert licenses.license_scan(odd).count() == 0 and licenses.license_scan(none).count() == 0


def test_licences_are_found_within_long_and_over_wrapped_lines(spark):
    t, filler = licenses.TEMPLATES, "lorem ipsum dolor sit amet consectetur " * 60
    wrapped = "\n".join(" * " + " ".join(t["MIT-text"].split()[k : k + 1 if k == 0 else k + 6]) for k in (0, *range(1, 40, 6)))
    prefix = "\n".join("# " + " ".join(t["GPL-3.0-header"].split()[k : k + 7]) for k in range(0, 45, 7))
    texts = [filler + t["MIT"] + " " + filler, filler + t["Apache-2.0"] + " " + filler + t["GPL-3.0"] + " " + filler, "/*\n" + wrapped + "\n */", "x\n" + prefix, t["MIT"] + " " + t["MIT"] + " Copyright 2020 " + t["MPL-2.0"], t["Apache-2.0-header"]]
    got = defaultdict(list)
    for r in licenses.license_scan(docs(spark, list(enumerate(texts)))).where("confirmed").collect():
        got[r["doc_id"]].append((r["line"], r["license"]))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(0, "MIT")], 1: [(0, "Apache-2.0"), (0, "GPL-3.0")], 2: [(1, "MIT-text")], 3: [(1, "GPL-3.0-header")], 4: [(0, "MIT"), (0, "MIT"), (0, "MPL-2.0")], 5: [(0, "Apache-2.0"), (0, "Apache-2.0-header")]}


# --- pipeline ----------------------------------------------------------------------


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    sf, n = "/root/testdata/sf0.001", []
    df = spark.read.parquet(f"{sf}/documents.parquet")
    columns = df.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        n.append(df.count())
        df = stage(spark, df, sf)
        assert k + 1 == len(corpus_pipeline.STAGES) or df.columns == columns
    assert n[1] < n[0] and n[2] < n[1] and n[3] <= n[2]
    assert df.count() == n[4] and df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_registered_sql_matches(spark):
    import glob
    import os

    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(sql).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        assert sorted(map(tuple, got[cols].astype(str).values)) == sorted(map(tuple, want[cols].astype(str).values)), name


def test_texts_of_repeated_ids_are_the_largest(spark):
    rows = docs(spark, [(1, "a"), (2, "b c"), (2, "b"), (2, None), (3, "d"), (None, "e")])
    ids = common.written(spark.createDataFrame([(1,), (2,)], "doc_id long"), "ids")
    assert sorted(map(tuple, jaccard_join._texts(ids, rows).collect())) == [(1, "a"), (2, "b c")]
    assert spark.conf.get(common.CLEANUP) == "false"


def test_columns_with_dots_pass_through(spark):
    df = docs(spark, [(k, f"text number {k} of a few words\nand a line", "en", "s") for k in range(6)]).withColumn("a.b", F.lit("x")).withColumn("c`d", F.lit("y"))
    bench = spark.createDataFrame([(1, "nothing of it")], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(6)], "doc_id long, quality int, toxic int")
    kept = [decontamination.decontaminate(df, bench), decontamination.decontaminate(df, bench, "span"), line_spread.without_boilerplate(df).drop("n_cut"), jaccard_join.one_of_each(df), quality_rules.cascade(df).drop("failed_rule"), quality_model.scored(df, quality_model.fit(df, labels)).drop("score")]
    for got in [*kept, mixing.mixed_documents(df)]:
        assert got.columns == df.columns
    for got in kept:
        assert sorted(r["doc_id"] for r in got.collect()) == list(range(6)) and {(r["a.b"], r["c`d"]) for r in got.collect()} == {("x", "y")}
    assert {(r["a.b"], r["c`d"]) for r in mixing.mixed_documents(df).collect()} == {("x", "y")}


def test_an_item_prefix_that_many_share_is_counted_for_each(spark):
    shared = " ".join(f"p{k}" for k in range(10))
    items = [(k, f"{shared} own{k}") for k in range(40)]
    df = docs(spark, [(1, f"before {shared} behind"), (2, f"{shared} own7"), (3, "p1 p2")])
    want = {1: 40, 2: 40, 3: 0}
    for most in (200_000, 10, 0):
        got = decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string"), max_set=most).collect()
        assert {r["doc_id"]: r["n_items"] for r in got} == want and len({r["items_sha256"] for r in got}) == 2


def test_labelled_rows_are_found_without_a_shuffle_of_texts(spark, monkeypatch):
    df = docs(spark, [(k, f"word {k} " * (k % 7 + 1)) for k in range(200)])
    labels = spark.createDataFrame([*[(k, k % 2, 0) for k in range(150)], *[(k, 1, 1) for k in range(0, 20)], (None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    rows = quality_model.labelled_statistics(df, labels)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "text" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x or "SortMergeJoin" in x) and "BroadcastHashJoin" in plan
    got = sorted((r["fold"], r["y"]) for r in rows.collect())
    assert got == sorted((quality_model.fold(k), 1 if k < 20 else k % 2) for k in range(150) if quality_model.fold(k) != quality_model.HELD_OUT)
    monkeypatch.setattr(quality_model, "TRAIN_ROWS", 40)
    assert 10 < quality_model.labelled_statistics(df, labels).count() < 80


def test_partition_sums_solve_the_normal_equations(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["aa", "B", "c1", "dd.", "#", "eee"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    y = [int(t.count("#") < len(t) / 40) for t in texts]
    df, labels = docs(spark, list(enumerate(texts))).repartition(7), spark.createDataFrame([(k, v, 0) for k, v in enumerate(y)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(df, labels)
    own = [k for k in range(300) if quality_model.fold(k) not in (quality_model.HELD_OUT, quality_model.CALIBRATE)]
    x = np.array([quality_model.statistics(texts[k]) for k in own])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.spread, np.maximum(x.std(0), 1e-9), atol=1e-7)
    z = quality_model.fourier((x - model.mean) / model.spread)
    want = np.linalg.solve(z.T @ z + quality_model.RIDGE * len(own) * np.eye(z.shape[1]) / quality_model.N_FEATURES, z.T @ np.array([y[k] for k in own]))
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)
    # Inner products of the features approach the kernel as their number grows.
    pts = np.random.default_rng(1).normal(size=(40, 22))
    f = quality_model.fourier(pts, n=20_000)[:, :-1]
    kernel = np.exp(-((pts[:, None] - pts[None]) ** 2).sum(2) / (2 * 22))
    assert np.abs(f @ f.T - kernel).max() < 0.05


def test_templates_are_ranked_by_compression_and_winners_confirmed(spark):
    import zstandard

    t, rng = licenses.TEMPLATES, random.Random(10)
    filler = lambda n: " ".join("".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 8))) for _ in range(n))
    m = licenses.Matcher()

    def saved(k, block):
        raw, own = " ".join(block).encode(), " ".join(licenses.words(list(t.values())[k])).encode()
        as_dict = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = lambda x, **kw: len(zstandard.ZstdCompressor(level=9, write_content_size=False, **kw).compress(x))
        return (size(raw) - size(raw, dict_data=as_dict)) / m.own[k]

    for name, text in t.items():
        block = licenses.words(f"{filler(30)} {text} {filler(30)}")
        got, want = [k for _, k in m.ranked(block)], sorted(range(len(t)), key=lambda k: -saved(k, block))
        own = m.names.index(name)
        assert m.reductions(block)[own] >= licenses.WIN and got == want and own in got[:3]
    # Whole files, over lines and behind comment signs, with a word or two of other wording.
    texts = [f"{filler(80)}\n" + "\n".join(" * " + " ".join(x.split()[k : k + 9]) for k in range(0, len(x.split()), 9)) + f"\n{filler(80)}" for x in t.values()]
    got = defaultdict(set)
    for r in licenses.license_scan(docs(spark, list(enumerate(texts)))).where("confirmed").collect():
        got[r["doc_id"]].add(r["license"])
        assert r["saving"] >= licenses.WIN and r["wording"] >= licenses.CONFIRM
    assert all(name in got[k] for k, name in enumerate(t))
    exact = {"GPL-2.0-header", "GPL-3.0-header", "LGPL-2.1-header", "LGPL-3.0-header", "AGPL-3.0-header", "BSD-2-Clause-full", "BSD-3-Clause-full"}
    assert all(got[k] & exact == {name} for k, name in enumerate(t) if name in exact)
    mit = t["MIT-full"].replace("free of charge", "without charge").replace("merge, ", "")
    row = licenses.license_scan(docs(spark, [(1, mit)])).where("license = 'MIT-full'").first()
    assert row["confirmed"] and '"free of"' in row["differences"] and "merge" in row["differences"]
    prose = "The copyright office issued a licence for fishing; the warranty of the boat had run out and permission is needed to redistribute its catch."
    assert licenses.license_scan(docs(spark, [(1, prose), (2, None), (3, "")])).where("confirmed").count() == 0


def test_hard_secrets_and_look_alikes_beside_names(spark):
    rng = random.Random(31)
    made = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda n=7: made("aeioulnrstdmbcfgp", n)
    prose = lambda: " ".join(word(rng.randint(3, 9)) for _ in range(12))
    secret = ['aws_secret_access_key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"', "password: hunter2Blue!9x", f"use ghp_{made(alnum, 36)} now", f"AKIA{made(alnum[26:], 16)} is it", f"slack xoxb-{made(alnum, 12)}-{made(alnum, 24)}"]
    plain = ['cache_key = "user_profile_page_v2_2024"', f'"integrity": "sha512-{made(alnum + "+/", 86)}=="', f'<img src="data:image/png;base64,iVBORw0KGgo{made(alnum + "+/", 90)}">', f"commit {made('0123456789abcdef', 40)}", "uuid 123e4567-e89b-12d3-a456-426614174000", "see /usr/local/share/things/readme.txt here", "call getUserProfileFromRemoteCache now"]
    # A form of neither side's examples: account keys of connection strings, and names of translations.
    held = {True: [f"Endpoint=x;AccountKey={made(alnum + '+/', 60)}==;" for _ in range(40)], False: [f'label_key("{word()}.{word()}.{word()}_title")' for _ in range(40)]}
    lines = [(x, True) for x in secret] + [(x, False) for x in plain] + [(x, k) for k, v in held.items() for x in v]
    rows = [(k, f"{prose()} {x} {prose()}") for k, (x, _) in enumerate(lines)]
    corpus = docs(spark, [*rows, *[(1000 + k, f"{prose()} {prose()}") for k in range(200)]])
    found = {r["doc_id"] for r in secrets.secret_scan(corpus).where("is_secret").collect()}
    told = [(x, k in found) for k, (x, _) in enumerate(lines)]
    assert all(got == want for (x, got), (_, want) in zip(told[: len(secret) + len(plain)], lines, strict=False)), [t for t, (_, w) in zip(told, lines, strict=True) if t[1] != w][:12]
    right = [got == want for (_, got), (_, want) in zip(told, lines, strict=True)][len(secret) + len(plain) :]
    assert sum(right[:40]) >= 36 and sum(right[40:]) >= 36, (sum(right[:40]), sum(right[40:]))


def test_the_plan_of_a_mix_starts_no_python_workers_of_its_own(spark):
    rows = spark.createDataFrame([("b", 300), (None, 60), ("a", 900)], "source string, size long")
    plan = mixing._driver_plan(rows, mixing.WEIGHTS)
    assert "RDD" not in plan._jdf.queryExecution().toString()  # rows by way of Python's RDDs pass through workers
    assert [r[:4] for r in plan.orderBy("sid").collect()] == [(0, "a", 900, 787.5), (1, "b", 300, 315.0), (2, None, 60, 157.5)]
    none = mixing._driver_plan(rows.limit(0), mixing.WEIGHTS)
    assert none.schema == plan.schema and none.count() == 0
