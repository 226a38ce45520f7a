"""The training-data operators against brute force on small fixtures."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat_format, decontamination, exact_dedup, line_dedup, lm_scoring, near_dedup, pii, sentencepiece_codec, sharding, toxicity
from loomgraph.llm.words import Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, kept string, digest string, words string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(low(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sentence(seed, n=60):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n))


ODD = [
    (1, None), (2, ""), (3, "   "), (4, "one"), (5, "É é one TWO"), (6, sentence(1)), (7, sentence(1)), (8, sentence(1) + " tail"), (9, sentence(2, 20_000)), (10, "a\tb  c\n"), (11, "a b c "),
    (11, "a b c "), (12, sentence(3) + "\n" + sentence(4)), (13, "x\n" + sentence(4) + "\ny\n" + sentence(4)), (14, "\n".join(["same line of words here"] * 40)), (None, "a b c "), (None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(i, t, "k", "d", "w") for i, t in ODD], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "</s>[INST] \\ ok [/INST]"), (1, 2, "assistant", "[/ROLE]\\[INST]<s>"), (1, 3, "assistant", None), (1, 4, "user", "end"), (2, 0, "assistant", "\\"), (3, 0, None, "x\ny"), (None, 0, "user", "q")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    examples = chat_format.expand(frame)
    got = {r["conv_id"]: r for r in chat_format.digests(examples).collect()}
    for conv in (1, 2, 3, None):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        said = "".join(t for role, t in own if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in own))
        assert r["loss_chars"] == len(said) and r["loss_sha256"] == sha(said)
    targets = [(r["target"], r["n_context"]) for r in examples.filter("conv_id = 1").orderBy(F.col("target").asc_nulls_last()).collect()]
    assert targets == [(2, 2), (3, 3), (None, 5)]
    shown = examples.filter("conv_id = 1 and target = 2").first()
    assert shown["formatted"][shown["loss_start"] : shown["loss_end"]].replace("\\", "") == "[/ROLE][INST]<s>" and "</s>[INST] " not in shown["formatted"][len("<s>[ROLE]system[/ROLE]s</s>[INST] ") : -30]
    assert chat_format.digests(chat_format.expand(frame.limit(0))).count() == 0


def test_decontamination(spark, odd, none):
    items = [(1, " ".join(sentence(1).split()[5:25])), (2, "W1 one"), (3, sentence(4)), (4, None), (5, ""), (None, sentence(3)), (1, "É é one two")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[a : a + min(10, len(w))])].add(i)
    want = set()
    for i, t in ODD:
        w, hit, owners = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    owners |= windows[tuple(w[a : a + n])]
        owners = sorted(str(x) for x in owners if x is not None)
        want.add((i, len(w), len(hit), len(owners), sha(",".join(owners)), bool(hit)))
    got = decontamination.contamination(odd, bench).drop("text_hash")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len({(i, t) for i, t in ODD})
    left = decontamination.drop_contaminated(odd, bench)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} >= {1, 2, 3, 9, 10, 11, 14} and not {6, 7, 12, 13, 5} & {r["doc_id"] for r in left.collect()}
    assert decontamination.contamination(none, bench).count() == 0 and not any(r["contaminated"] for r in decontamination.contamination(odd, bench.limit(0)).collect())


def test_a_long_text_that_is_all_benchmark(spark):
    long = sentence(9, 30_000)
    docs = spark.createDataFrame([(1, long), (2, "x " + long[:5000])], "doc_id bigint, text string")
    got = decontamination.contamination(docs, spark.createDataFrame([(7, long)], "item_id bigint, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"]) for r in got] == [(30_000, 30_000), (len(words(long[:5000])) + 1, len(words(long[:5000])) - (long[5000] != " "))]


def test_dropping_stages_do_not_depend_on_how_rows_are_dealt(spark):
    """Ties, and columns that bear the helpers' names."""
    text = sentence(1)
    rows = [(1, "a b c", "x", "p"), (1, "a  b c", "y", "p"), (1, "a\tb c", "x", "q"), (1, "a b c", "z", "p"), (2, "a b c", "x", "p"), (3, text, "x", "p"), (3, text, "y", "p"), (3, text, "y", "p"), (4, text + " tail", "x", "p"), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, row_key string, bad_id string, Bad_Hash int, __key int")
    bench = spark.createDataFrame([(1, text)], "item_id bigint, text string")
    for drop in (exact_dedup.drop_copies, near_dedup.drop_near_copies, lambda d: decontamination.drop_contaminated(d, bench)):
        found = [sorted(map(tuple, drop(frame.repartition(n)).collect()), key=repr) for n in (1, 2, 3)]
        assert found[0] == found[1] == found[2] and set(found[0]) <= {(*r, 1, 2) for r in rows} and drop(frame).columns == frame.columns
    kept = exact_dedup.drop_copies(frame).select("doc_id").collect()
    assert sorted(map(repr, kept)) == sorted(f"Row(doc_id={i})" for i in (1, 3, 4, None))
    assert sorted(map(repr, near_dedup.drop_near_copies(frame).select("doc_id").collect())) == sorted(f"Row(doc_id={i})" for i in (1, 3, None))


def brute_lines(docs, least):
    """Deletes every run of at least ``least`` words that occurs earlier, window by window."""
    seen, gone = {}, collections.defaultdict(set)
    lines = {i: [(n, x.strip(" ")) for n, x in enumerate(t.split("\n")) if x.strip(" ")] for i, t in docs.items()}
    spans = []
    for i in sorted(lines):
        own = lines[i]
        for a in range(len(own)):
            total = 0
            for b in range(a, len(own)):
                total += len(re.split(" +", own[b][1]))
                if total >= least:
                    spans.append((i, a, b, tuple(x for _, x in own[a : b + 1])))
    for i, a, b, content in spans:
        if content not in seen:
            seen[content] = (i, a, b)
        elif seen[content][0] != i or a > seen[content][2]:
            gone[i] |= set(range(own_line(lines, i, a), own_line(lines, i, b) + 1))
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in docs.items()}


def own_line(lines, i, a):
    return lines[i][a][0]


def test_line_dedup(spark, odd, none):
    line = {k: f"{k} " + sentence(ord(k), 19) for k in "ABCDEFGH"}
    build = lambda s: "\n".join(line.get(c, "") for c in s)
    docs = {1: build("ABC.DEF"), 2: build("A.B.CXG").replace("X", ""), 3: build("HHHHHHHHH"), 4: build("GABCH"), 5: build("BCDEFA"), 6: "short\nshort", 7: "short\nshort", 8: build("HHH") + "\n" + sentence(5, 60), 9: sentence(5, 60) + "\n "}
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame).collect()}
    want = brute_lines(docs, line_dedup.MIN_WORDS)
    assert {i: got[i]["text"] for i in docs} == want
    assert got[9]["text"] == " " and got[9]["n_removed"] == 1 and got[6]["text"] == "short\nshort"
    result = line_dedup.dedup_lines(odd)
    assert result.count() == len(ODD) and line_dedup.dedup_lines(none).count() == 0
    texts = collections.defaultdict(list)
    for r in result.collect():
        texts[r["doc_id"]].append(r["text"])
    assert None in texts[1] and texts[11] == ["a b c ", "a b c "] and texts[13] == ["x\ny"]


def test_line_dedup_of_runs_shared_with_several_places(spark):
    """Runs that different earlier places share in part, in any order and over many partitions."""
    dice = random.Random(3)
    line = [f"l{k} " + sentence(100 + k, dice.choice([4, 9, 19, 30, 60])) for k in range(14)]
    docs = {i: "\n".join(line[dice.randrange(14)] if dice.random() < 0.3 else line[(i + k) % 14] for k in range(dice.randrange(2, 14))) for i in range(60)}
    docs[60] = "\n".join(line[0] for _ in range(200))
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(7)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame).collect()}
    assert got == brute_lines(docs, line_dedup.MIN_WORDS)


def test_lm_scoring_counts_every_word_and_bigram(spark, odd, none):
    # 66,000 words that are more frequent than the last four: a capped vocabulary can't tell those apart.
    docs = [(i, " ".join(f"v{k}" for k in range(i % 2 * 33_000, i % 2 * 33_000 + 33_000))) for i in range(6)]
    docs += [(10, "ra rb ra rb v7"), (11, "rc rd rc v9 rd"), (12, "ra rb v7 rc"), (13, None), (14, "v1"), (None, "rb rd")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(10, 1), (10, 0), (1, 1), (12, 0), (None, 1)], "doc_id int, quality int")
    many, few = ({r["doc_id"]: r for r in lm_scoring.score(frame, labels, **k).collect()} for k in ({"chunk": 50_000}, {}))

    def counts(chosen):
        one, two, context = collections.Counter(), collections.Counter(), collections.Counter()
        for _, t in chosen:
            w = words(t)
            one.update(w)
            two.update(zip(["", *w], w, strict=False))
            context.update(["", *w][: len(w)])
        return one, two, context

    target = [d for d in docs if d[0] in (1, 10)]
    vocabulary = len(counts(docs)[0])
    scale = sum(counts(target)[0].values()) / sum(counts(docs)[0].values())

    def loss(t, model, k):
        one, two, context = model
        w, s = words(t), lm_scoring.SMOOTH
        tokens = sum(one.values()) * k
        p = [(two[a, b] * k + s * (one[b] * k + 1) / (tokens + vocabulary)) / (context[a] * k + s) for a, b in zip(["", *w], w, strict=False)]
        return -sum(map(math.log, p)) / len(w)

    for d in docs:
        i, t = d
        assert many[i]["n_tokens"] == few[i]["n_tokens"] == len(words(t))
        for got in (many[i], few[i]):
            if t:
                # The models of all other documents.
                assert got["target_loss"] == pytest.approx(loss(t, counts([x for x in target if x is not d]), 1), abs=1e-9)
                assert got["background_loss"] == pytest.approx(loss(t, counts([x for x in docs if x is not d]), scale), abs=1e-9)
            else:
                assert got["score"] is None
    assert lm_scoring.score(odd, labels, chunk=2000).count() == len(ODD) and lm_scoring.score(none, labels).count() == 0
    assert lm_scoring.score(odd, labels.limit(0)).filter("isnan(score)").count() == 0


def test_sentencepiece_parity_and_round_trip(odd, none):
    import sentencepiece

    model = sentencepiece_codec.read_model()
    reference = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoded = sentencepiece_codec.encode(odd, model)
    rows = encoded.collect()
    by = collections.defaultdict(list)
    for i, t in ODD:
        by[i].append(t or "")
    for r in rows:
        assert list(r["ids"]) in [reference.encode(t) for t in by[r["doc_id"]]] and r["parity"] and r["roundtrip"] and r["n_tokens"] == len(r["ids"])
    assert sorted(r["text"] for r in sentencepiece_codec.decode(encoded, model).collect()) == sorted(t or "" for _, t in ODD)
    codec = sentencepiece_codec.Codec(model)
    for t in ["  a  b ", " x", "x ", "▁a", "a▁ b", "\n\n", "é😀\x00 y", " ", "▁", "日本 語  "]:
        assert codec.encode(t) == reference.encode(t)
    assert codec.decode(codec.encode("▁a")) != "▁a"  # the marker itself doesn't come back
    assert sentencepiece_codec.encode(none, model).count() == 0


def test_unigram_models_are_rebuilt():
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(sentencepiece_codec.read_model())
    m.trainer_spec.model_type = m.trainer_spec.UNIGRAM
    for i, p in enumerate(m.pieces):
        if p.type == 1:
            p.score = -8.0 - (i % 97) / 10 - 1 / len(p.piece)
    codec = sentencepiece_codec.Codec(m.SerializeToString())
    for t in ["hello world", " the  quick brown fox", "naïve 😀 text"]:
        assert codec.encode(t) == codec.reference.encode(t)


def altered(change):
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(sentencepiece_codec.read_model())
    change(m)
    return sentencepiece_codec.Codec(m.SerializeToString())


BLANKS = ["\ta  b\n", "x\n", "\n\n", "  lead and trail  ", " ", "   ", "", "a \t b", "▁ a", "one two"]


def test_other_normalisers_have_parity():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    def squeeze(m):
        m.normalizer_spec.remove_extra_whitespaces = True

    def mapped(m):
        squeeze(m)
        spec = proto.NormalizerSpec.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec())
        m.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap

    def bare(m):
        m.normalizer_spec.add_dummy_prefix = False

    for change in (squeeze, mapped, bare):
        codec = altered(change)
        for t in [*BLANKS, "ﬁne ① ｆｕｌｌ"]:
            assert codec.encode(t) == codec.reference.encode(t), (change.__name__, t)


def test_user_defined_pieces_stay_whole():
    def define(m):
        next(p for p in m.pieces if p.piece == "qu").type = 4
        for name in ("<mask>", "<mask>x"):
            piece = m.pieces.add()
            piece.piece, piece.score, piece.type = name, 0.0, 4

    codec = altered(define)
    for t in [*BLANKS, "the <mask> quick", "<mask>x<mask>", "queue qu", "a<mask> b"]:
        assert codec.encode(t) == codec.reference.encode(t), t


def test_long_texts_are_cut_where_parts_do_not_meet(spark):
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_model())
    unbroken = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(1_000_000))
    for t in [("word  " * 20_000) + unbroken[:50_000] + " tail " * 9_000, " " * 70_000, "a" + " " * 40_000 + "b " * 30_000]:
        assert len(codec.parts(t)) >= 1 and codec.encode(t) == codec.reference.encode(t)
    assert len(codec.parts("word " * 20_000)) > 2
    frame = spark.createDataFrame([(1, unbroken), (2, None)], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in sentencepiece_codec.encode(frame, sentencepiece_codec.read_model()).drop("ids").collect()}
    assert rows[1]["parity"] and rows[1]["roundtrip"] and rows[1]["n_bytes"] == 1_000_000 and rows[2]["n_tokens"] == 0


def brute_classes(docs):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = collections.Counter(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else None
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = sum((sets[a] & sets[b]).values())
                if both >= near_dedup.THRESHOLD * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_classes(spark, odd, none):
    docs = [(10 * g + v, " ".join(w if (k * 13 + v * 17) % 97 or not v else f"edit{v}" for k, w in enumerate(sentence(g, 120).split()))) for g in range(12) for v in range(5)]
    # A chain whose ends aren't similar, and one word sequence in other letters.
    base = sentence(77, 200).split()
    docs += [(500 + k, " ".join(base[8 * k : 8 * k + 140])) for k in range(4)] + [(600, sentence(5, 4)), (601, sentence(5, 4).upper()), (602, None), (603, "")]
    docs += [(700 + k, "spam " * (30 + k)) for k in range(3)]
    got = near_dedup.near_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(docs)
    sizes = collections.Counter(r["class_id"] for r in got)
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)
    result = near_dedup.near_classes(odd)
    assert result.count() == len(ODD) and near_dedup.near_classes(none).count() == 0
    left = near_dedup.drop_near_copies(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} >= {1, 2, 6, 9, None} and 7 not in {r["doc_id"] for r in left.collect()}


@pytest.mark.parametrize("patience", [0, 1])
def test_classes_of_a_band_value_without_a_common_text(spark, monkeypatch, patience):
    """Copies of an unseen text, near 0.8 to one another, and chains: links that the first leader doesn't see.

    Without patience all that the first leader leaves goes to the exact join.
    """
    monkeypatch.setattr(near_dedup, "PATIENCE", patience)
    rng = np.random.default_rng(4)
    docs = []
    for g in range(3):
        base = sentence(100 + g, 220).split()
        for v in range(40):
            own = list(base)
            for at in rng.choice(220, 4 + v % 3, replace=False):
                own[at] = f"e{v}x{at}"
            docs.append((1000 * g + v, " ".join(own)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(frame).collect()}
    want = brute_classes(docs)
    assert len(set(want.values())) > 3 and got == want


def test_near_classes_of_null_and_string_ids(spark):
    same, other = sentence(900, 80), sentence(901, 80)
    docs = [(None, same), (None, other), (None, None), ("b", same.upper()), ("a", same + " tail"), ("c", other), ("c", sentence(902, 80)), ("d", ""), ("c", other)]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in near_dedup.near_classes(frame).collect()), key=repr)
    want = [(None, "a", 3), (None, "c", 3), (None, None, 1), ("a", "a", 3), ("b", "a", 3), ("c", "c", 1), ("c", "c", 3), ("c", "c", 3), ("d", "d", 1)]
    assert got == sorted(want, key=repr)
    left = sorted(((r["doc_id"], r["text"]) for r in near_dedup.drop_near_copies(frame).collect()), key=repr)
    assert left == sorted([("a", same + " tail"), ("c", other), ("c", sentence(902, 80)), ("d", ""), (None, None)], key=repr)


def test_dart_signatures_estimate_the_weighted_coefficient():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 1 << 62, 600).astype(np.uint64)])
    heavy = np.concatenate([a, a[:1500]])  # half of the elements with weight 2
    k = 512
    s = near_dedup.signatures(*near_dedup.unit_regions(np.repeat([0, 1, 2], [3000, 3000, 4500]), np.concatenate([a, b, heavy])), 3, k)
    assert (s[0] == s[1]).mean() == pytest.approx(2400 / 3600, abs=0.08) and (s[0] == s[2]).mean() == pytest.approx(3000 / 4500, abs=0.08)


def test_toxicity(spark, none):
    bad = ["vexling", "grumbold", "stinkard"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = sentence(i, 30)
        if toxic:
            text = f"{text} {bad[i % 3]} {sentence(i + 1, 10)} {bad[(i + 1) % 3]}"
        docs.append((i, text, "en"))
        labels.append((i, 1, int(toxic)))
    docs += [(2000, "you vexlimg and grumbolt stinkart", "en"), (2001, sentence(7, 40), "en"), (2002, None, None), (2003, "", None), (None, "vexling grumbold", None)]
    docs += [(2004, sentence(8, 20) + ' the word "vexling" means little', "en")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, held_out string").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(frame, marks).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(900))
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in held) >= 0.99 * len(held)
    assert got[2000]["predicted"] == 1 or got[2000]["score"] > 10 * got[2001]["score"]
    assert got[2001]["predicted"] == got[2002]["predicted"] == got[2003]["predicted"] == 0 and got[None]["predicted"] == 1
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    left = toxicity.drop_toxic(frame, marks)
    assert left.columns == frame.columns and {r["doc_id"] for r in left.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert toxicity.score(none, marks).count() == 0 and toxicity.score(frame, marks.limit(0)).filter("predicted = 1").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_toxicity(docs, toxic, half):
    """Scores by plain loops: ``toxic`` and ``half`` of each learned document, ``docs`` are (id, text)."""
    texts = {i: low(t) for i, t in docs}
    terms_of = {i: {("w", w) for w in words(texts[i])} | {("p", w[:n]) for w in words(texts[i]) for n in range(4, 9) if n <= len(w)} for i in toxic}

    def counts(halves):
        n = collections.Counter()
        for i in toxic:
            if half[i] in halves:
                n[toxic[i]] += 1
                n.update((term, toxic[i]) for term in terms_of[i])
        return n

    every = counts((0, 1))
    odds = lambda n, t: math.log((n[t, 1] + 0.5) / (n[1] + 1)) - math.log((n[t, 0] + 0.5) / (n[0] + 1))
    candidates = [t for t in {x for s in terms_of.values() for x in s} if every[t, 1] >= 3 and odds(every, t) >= 2]

    def lexicon(halves):
        n = counts(halves)
        chosen = {t: odds(n, t) for t in candidates if odds(n, t) >= 3 and n[t, 1] >= 2}
        return {t: w for (k, t), w in chosen.items() if k == "w"}, {t: w for (k, t), w in chosen.items() if k == "p"}

    whole = lexicon((0, 1))
    near = lambda w, names: [x for x in names if len(x) > 2 and abs(len(x) - len(w)) < 2 and distance(w, x) <= 1]
    ordinary = {w for s in terms_of.values() for k, w in s if k == "w" and w not in whole[0] and every[(k, w), 0] >= 1 and near(w, whole[0])}

    def row(text, names, starts):
        best, spelt, quotes, count = {}, 0.0, 0.0, 0
        for m in WORD.finditer(text):
            w = m.group()
            plain = max([names.get(w, 0.0), *(starts.get(w[:n], 0.0) for n in range(4, 9) if n <= len(w))])
            edited = max([0.0, *(names[x] for x in near(w, names))]) if not plain and w not in ordinary else 0.0
            if not plain and not edited:
                continue
            line, stop = text.rfind("\n", 0, m.start()) + 1, (text + "\n").find("\n", m.end())
            before, after = text[max(line, m.start() - 60) : m.start()], text[m.end() : min(stop, m.end() + 60)]
            if text[line : line + 1] == ">" or before.count('"') % 2 and '"' in after:
                quotes = max(quotes, plain or edited)
                continue
            count += 1
            if plain:
                best[w] = plain
            else:
                spelt = max(spelt, edited)
        top = sorted(best.values(), reverse=True)
        return [top[0] if top else 0.0, sum(top[:3]), math.log1p(count), quotes, spelt, 1.0]

    crossed = {h: lexicon((1 - h,)) for h in (0, 1)}
    x = np.array([row(texts[i], *crossed[half[i]]) for i in toxic])
    y = np.array(list(toxic.values()), dtype=float)
    beta, ridge = np.zeros(6), np.diag([1.0] * 5 + [1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
    return {i: 1 / (1 + math.exp(-float(np.clip(np.array(row(t, *whole)) @ beta, -30, 30)))) for i, t in texts.items()}


def test_toxicity_scores_equal_brute_force(spark):
    rng, bad = np.random.default_rng(9), ["vexling", "grumbold", "vile"]
    docs = [(i, f"{sentence(i % 150, 12)} {bad[i % 3] if i % 4 == 0 else 'fine'} {'grumbolt' if i % 20 == 0 else 'thing'}\n{sentence(i, 6)}") for i in range(240)]
    docs += [(500 + k, t) for k, t in enumerate(["so vlle", 'he said "vexling" once', "> vexling\nvile", "Vexlings are VILE", "", "vexling vexling grumbold vile", "nothing here", "vexling vexling grumbold vile", "vexxling"])]
    docs += [(600 + k, "\n".join(rng.permutation(["vile", "word", "grumbld", '"vile" x', "> y vexling", "fine"]))) for k in range(6)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = {i: int(i % 4 == 0) for i in range(240)}
    marks = spark.createDataFrame(list(labels.items()), "doc_id bigint, toxic int")
    half = {r["doc_id"]: r["half"] for r in frame.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half")).collect()}
    learned = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 3 != 1}
    want = brute_toxicity(docs, learned, half)
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.score(f, marks).collect()} for f in (frame, frame.repartition(7)))
    assert one == two and all(one[i] == pytest.approx(want[i], abs=1e-6) for i in want)
    assert one[505] == one[507] and one[500] > one[506]


def test_toxic_words_of_any_length_and_repeated_ids(spark):
    long, short = "ばか" * 30, "zx"
    docs = [(i, f"{sentence(i, 12)} {long if i % 6 == 0 else short if i % 6 == 3 else 'fine'}") for i in range(240)]
    frame = spark.createDataFrame(docs + docs[:60] * 3 + [(900, f"now {long}"), (901, f"now {short}"), (902, "now zy"), (903, "all fine")], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(frame, marks).filter("doc_id >= 900").collect()}
    assert got == {900: 1, 901: 1, 902: 0, 903: 0}
    once = toxicity.score(frame.dropDuplicates(), marks).distinct().collect()
    assert sorted(map(repr, once)) == sorted(map(repr, toxicity.score(frame, marks).distinct().collect()))


def test_rare_and_short_lexicon_words_are_found_misspelt():
    rows = [{"kind": "w", "term": x} for x in ("grumble", "vile", "mud")]
    lexicon = toxicity._lexicon(rows, np.array([300.0, 3.0, 3.0]), np.zeros(3), (2000.0, 18_000.0))
    for word in ("grunble", "vlle", "vil", "viile", "mudd"):
        assert lexicon.match(word)[1] > 0, word
    assert lexicon.match("grammar") == lexicon.match("village") == (0.0, 0.0)
    texts = toxicity.features(Words(pa.array(["so vlle a word", "so fine a word", "so vlle a word"])), lexicon)
    assert texts[0, 4] > 0 and (texts[0] == texts[2]).all() and not texts[1].any()


def test_levenshtein_automaton_equals_brute_force():
    rng = np.random.default_rng(2)
    make = lambda: "".join(rng.choice(list("abc"), rng.integers(1, 8)))
    lexicon = sorted({make() for _ in range(60)})
    trie, quick = toxicity.Trie(iter(lexicon)), toxicity.Lexicon({}, {}, lexicon)
    for _ in range(300):
        word = make()
        want = [x for x in lexicon if distance(word, x) <= 1]
        assert sorted(trie.within_one(word)) == want and (sorted(quick.near(word)) == want or len(word) < 3)


def base_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii(spark, odd, none):
    rng = np.random.default_rng(3)
    parts = ["a.b@c.de", "@", "x@y", "é", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", ".", " ", "-", "@@", "_a%+b@h-h.x.y.", "7", "\n", "+123456789", "https://a.b/c?d=e.", "user id: ab12-9", "mailto:x@y.zz"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(400)] + ["", "x" * 50_000 + " me@host.org", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(frame).collect()}
    for i, t in enumerate(texts):
        assert got[i]["base"] == base_pii(t or ""), t
        assert set(filter(None, got[i]["base"].split(","))) <= set(got[i]["spans"].split(","))
    show = "see https://a.org/x, mailto:me@b.co or account number: AB12345 by @some_one"
    spans = pii.spans_of(show, pii._automaton())
    assert {show[a:b] for k, a, b in spans if k in ("url", "account", "handle")} == {"https://a.org/x", "AB12345", "@some_one"}
    assert pii.mask("to me@b.co now", "email:3:10") == "to <email> now"
    assert pii.digests(pii.find_pii(odd)).count() == len(ODD) and pii.find_pii(none).count() == 0


def added(text):
    return [(k, text[a:b]) for k, a, b in pii.spans_of(text, pii._automaton()) if k not in pii.BASE]


def test_identifiers_end_at_their_own_boundary_and_are_validated():
    assert added("IBAN: DE89 3704 0044 0532 0130 00 is ours") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert added("iban DE89370400440532013000.") == [("account", "DE89370400440532013000")]
    assert added("IBAN: DE88 3704 0044 0532 0130 00") == [] and added("iban GB82-WEST-1234-5698-7654-32") == [("account", "GB82-WEST-1234-5698-7654-32")]
    assert added("ssn 078-05-1120") == [("account", "078-05-1120")] and added("ssn 666-05-1120, ssn 078-00-1120") == []
    assert added("user id: " + "a1" * 31) == [("account", "a1" * 31)] and added("user id: " + "a1" * 33 + ".") == [("account", "a1" * 33)] and added("passport: none") == []
    assert added('token = "11acdfb36bb72224148e6160f674b4be45601bff" x') == [("secret", "11acdfb36bb72224148e6160f674b4be45601bff")]
    assert added("password is swordfish") == [] and added("hi @" + "n" * 45 + " @") == [("handle", "@" + "n" * 45)]


@pytest.mark.parametrize("part", ["7", "1.", "1 ", "+1", "+1(", "a@", "www.", "iban ", "token=a1", "1.2.3.x", "12-", "@", "user id: "])
def test_long_runs_are_read_once(part):
    import time

    automaton, text = pii._automaton(), part * (1_000_000 // len(part))
    begun = time.process_time()
    spans = pii.spans_of(text, automaton)
    assert time.process_time() - begun < 8 and all(a < b for _, a, b in spans)


@pytest.mark.parametrize("tail", ["", "=", "-", "/", ": ", "=a"])
def test_cues_inside_one_run_read_it_once(tail):
    """Every cue, repeated; twice the text takes about twice the time."""
    import time

    automaton = pii._automaton()
    for cue in (*pii.CUES, *pii.SECRETS, "iban", "ssn", "mailto:"):
        seconds = []
        for size in (100_000, 400_000):
            text = (cue + tail) * (size // len(cue + tail))
            begun = time.process_time()
            pii.spans_of(text, automaton)
            seconds.append(time.process_time() - begun)
        assert seconds[1] < 10 * seconds[0] + 0.5, cue


def test_numbers_of_any_length():
    zeros = "0" * 5000
    assert pii.spans_of(zeros + "1.2.3.4", pii._automaton()) == [("ip", 0, 5007)]
    assert pii.spans_of(f"{zeros}.{zeros}.0.{zeros}255 " + "9" * 5000 + ".1.1.1", pii._automaton()) == [("ip", 0, 15_007)]
    assert base_pii("00001.02.0003.0 1.2.3.256") == ",".join(f"{k}:{a}:{b}" for k, a, b in pii.spans_of("00001.02.0003.0 1.2.3.256", pii._automaton()))


def brute_tokens(text):
    """Spans after the account and secret cues, each cue reading on from its own end."""
    spans, last = [], 0
    cues = [(m.end(), -len(c), m.start(), k) for k, own in (("account", pii.CUES), ("secret", pii.SECRETS)) for c in own for m in re.finditer(f"(?={re.escape(c)})", text.lower()) for m in [re.compile(re.escape(c)).match(text.lower(), m.start())]]
    for end, _, start, kind in sorted(cues):
        if start < last or (start and text[start - 1].isalnum()):
            continue
        at = re.compile(r"(?i)(?:\s{0,4}(?:is|no\.?|number|id|key|#|:|=))*\s{0,4}[\"'`]?").match(text, end).end()
        m = re.compile(r"[A-Za-z0-9+/_=.~-]+" if kind == "secret" else r"[A-Za-z0-9][A-Za-z0-9._-]*").match(text, at)
        token = m.group().rstrip("._-") if m else ""
        has = any(c.isdigit() for c in token), any(c.isalpha() for c in token)
        if has[0] and (len(token) >= 16 and has[1] if kind == "secret" else len(token) >= 4):
            spans.append((kind, at, at + len(token)))
            last = at + len(token)
    return spans


def test_tokens_after_cues_equal_brute_force():
    draw = np.random.default_rng(5)
    parts = ["token", "=", "secret", "user:", "login:", " ", ".", "-", "a", "7", "abcdef", "12345678", "account no", "user id", "/", "_", "é", '"', ": ", "api key", "is"]
    for _ in range(3000):
        text = "".join(draw.choice(parts, draw.integers(1, 25)))
        got = [s for s in pii.spans_of(text, pii._automaton()) if s[0] in ("account", "secret")]
        assert got == brute_tokens(text), text


def test_sharding(odd, none):
    rows = sharding.assign_shards(odd).collect()
    assert len(rows) == len(ODD)
    sizes = collections.defaultdict(list)
    for i, t in ODD:
        sizes[i].append((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    for r in rows:
        assert (r["size"], r["text_crc32"]) in sizes[r["doc_id"]] and r["law"] == "bytes" and r["grown_shard"] is None
    for shard in range(sharding.SHARDS):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert sharding.assign_shards(none).count() == 0


def test_shards_are_contiguous_and_balanced(spark):
    frame = spark.range(5000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 as int)) as text").repartition(7)
    rows = sorted(sharding.assign_shards(frame).collect(), key=lambda r: r["doc_id"])
    shards = [r["shard"] for r in rows]
    assert shards == sorted(shards)
    total = collections.Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    assert max(total.values()) - min(total.values()) <= 200


def test_exact_dedup(spark, odd, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in ODD:
        groups[norm(t)].append(i)
    rows = exact_dedup.find_copies(odd).collect()
    assert len(rows) == len(ODD)
    by = {sha(k): v for k, v in groups.items()}
    for r in rows:
        own = by[r["text_sha256"]]
        assert r["group_size"] == len(own) and r["keep_id"] == min((i for i in own if i is not None), default=None)
    assert sum(r["kept"] for r in rows) == len(groups)
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns and left.count() == len(groups)
    assert exact_dedup.find_copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_full_indexes_are_sent_on(monkeypatch):
    monkeypatch.setattr(exact_dedup, "FULL", 3)
    keys = sorted(bytes([i]) * 32 for i in range(10) for _ in range(1 + i % 3))
    mixed = [keys[(7 * i) % len(keys)] for i in range(len(keys))]
    for given in (keys, mixed):
        batch = pa.RecordBatch.from_pydict({"digest": pa.array(given, pa.binary()), "keep_id": list(range(len(keys))), "keep_tag": [0] * len(keys), "group_size": [1] * len(keys)})
        got = [r for b in exact_dedup._merge(iter([batch])) for r in b.to_pylist()]
        assert sum(r["group_size"] for r in got) == len(keys) and {r["digest"] for r in got} == set(keys) and (given is mixed or len(got) == 10)


def test_exact_dedup_of_string_ids(spark):
    frame = spark.createDataFrame([("b", "x  y", 1), ("a", "x y", 2), (None, "x\ty", 3), ("c", None, 4), ("c", "", 5), (None, "z", 6), (None, "z", 6)], "doc_id string, text string, kept int")
    rows = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.find_copies(frame).collect()), key=repr)
    want = [("b", "a", 3, False), ("a", "a", 3, True), (None, "a", 3, False), ("c", "c", 2, True), ("c", "c", 2, False), (None, None, 2, True), (None, None, 2, False)]
    assert rows == sorted(want, key=repr)
    left = exact_dedup.drop_copies(frame).collect()
    assert len(left) == 3 and {(r["doc_id"], (r["text"] or "")) for r in left} == {("a", "x y"), ("c", ""), (None, "z")}


def test_cuckoo_index_inserts_deletes_and_resizes():
    index, keys = exact_dedup.CuckooIndex(buckets=4, max_kicks=20), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.add(k, (False, i, 0), 1)
    assert len(index) == 3000 and index.resizes > 3 and all(index.keys[index.find(k)] == k for k in keys)
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert len(index) == 1500 and all((index.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))
    clash = keys[1][:10] + bytes(22)  # the same mark and buckets, another digest: a false positive
    assert index.find(clash) is None
    for k in [*keys[::2], clash]:
        index.add(k, (False, -1, 0), 2)
    assert len(index) == 3001 and index.values[index.find(clash)] == [(False, -1, 0), 2]
