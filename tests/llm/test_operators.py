"""Each operator against a plain version, on rows with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import jaccard_join as jj
from wardline.llm import language_id as li
from wardline.llm import packing as pk
from wardline.llm import piece_tokens as pt
from wardline.llm import pivot_search as ps
from wardline.llm import quality_rules as qr
from wardline.llm import sentence_dedup as sd
from wardline.llm import sharding as sh
from wardline.llm import suffix_dedup as sx
from wardline.llm import transcripts as tc
from wardline.llm.components import components
from wardline.llm.queries import tokenizer_path
from wardline.session import materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, label string, group string, n_words int, hash string"


def corpus():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeéß"), 1 + rng.integers(9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    line = lambda n: ". ".join(say(9).capitalize() for _ in range(n)) + "."
    base, passage, long = line(20), line(8), line(900)
    texts = [None, "", " \n\t", "word", "one two three", base, base, base.replace(" a", " b", 2), base + " tail of a few more words."]
    texts += [say(60) + ".\n" + passage + "\n" + say(50) for _ in range(6)]
    texts += [long, long + " " + passage, "x" * 3000, "spam " * 500, "Ünï ▁cödé \u0000 🎈 \r\n" * 7, "l1\nl1\nl2\nl1", "12 34 %%% ###"]
    texts += [f"{base[:-1]} and {i}." for i in range(30)] + [line(12) for _ in range(40)]
    return [(i, t, ["en", "de", None][i % 3], ["s", None][i % 2], 1, "r", "l", "g", 1, "h") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(7, 7), (None, 3)] + [(i, i + 1) for i in range(900, 960)]
    root = {x: x for link in links for x in link if x is not None}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        if a is not None:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    found = dict(rows(components(spark.createDataFrame(links, "a long, b long"))))
    assert all(found.get(x, x) == find(x) for x in root)


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    found = pk.best_fit_packing(pk.token_pieces(docs.union(docs.limit(1)), path, 512).drop("ids"), 512).collect()
    direct = Tokenizer.from_file(path)
    want = []
    for i, text, *_ in [*corpus(), corpus()[0]]:
        ids = [*direct.encode(text or "", add_special_tokens=False).ids, 1]
        cuts = enumerate(range(0, len(ids), 512))
        want += [(i, k, s, len(ids[s : s + 512]), zlib.crc32(np.array(ids[s : s + 512], "<u4").tobytes())) for k, s in cuts]
    assert sorted(tuple(r)[:5] for r in found) == sorted(want)
    filled = {}
    for r in found:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 512
    simple: list[int] = []  # first fit, longest first
    for n in sorted((r["length"] for r in found), reverse=True):
        k = next((k for k, held in enumerate(simple) if held + n <= 512), len(simple))
        simple[k : k + 1] = [n + (simple[k] if k < len(simple) else 0)]
    assert len(filled) <= len(simple)
    assert pk.best_fit_packing(pk.token_pieces(nothing, path).drop("ids")).count() == 0


def test_fullest_combination():
    rng = np.random.default_rng(5)
    for _ in range(60):
        counts = {int(x): int(n) for x, n in zip(rng.integers(1, 40, 5), rng.integers(1, 4, 5), strict=True)}
        room, sums = int(rng.integers(1, 90)), {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        chosen = pk.fullest(counts, room)
        assert sum(x * n for x, n in chosen.items()) == max(sums) and all(n <= counts[x] for x, n in chosen.items())


def repeated_bytes(texts, length):
    seen, out = set(), []
    for i, text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            piece = data[s : s + length]
            if piece in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("together", [sx.TOGETHER, 5])
def test_suffix_dedup(docs, nothing, monkeypatch, together):
    monkeypatch.setattr(sx, "TOGETHER", together)  # 5: common q-grams are refined in parts
    assert rows(sx.suffix_dedup(docs, keep_bytes=False)) == repeated_bytes([r[:2] for r in corpus()], 100)
    assert sx.suffix_dedup(nothing).count() == 0


@pytest.mark.parametrize("length, gram", [(8, 4), (400, 40)])
def test_suffix_dedup_of_other_lengths(spark, length, gram):
    """With 400 bytes a run has up to 361 windows."""
    rng = np.random.default_rng(length)
    parts = ["".join(rng.choice(list("abcdé "), int(n))) for n in rng.integers(5, 900, 12)]
    texts = [(i, "".join(parts[int(k)] for k in rng.integers(0, 12, 4))) for i in range(60)]
    found = sx.suffix_dedup(spark.createDataFrame(texts, "doc_id long, text string"), length, gram, keep_bytes=False)
    assert rows(found) == repeated_bytes(texts, length)


def test_suffix_dedup_refuses_lengths_it_cannot_take(docs):
    for length, gram in ((98, 40), (100, 101), (1 << 20, 40)):
        with pytest.raises(ValueError):
            sx.suffix_dedup(docs, length, gram)


def test_bucket_pointers():
    text = np.random.default_rng(2).integers(0, 2, 400).astype(np.uint8)
    starts = np.arange(400 - 12)
    found = sx.bucket_pointers(text, starts, 12)
    strings = [text[s : s + 12].tobytes() for s in starts]
    same = np.array(strings)[:, None] == np.array(strings)[None]
    assert ((found[:, None] == found[None]) == same).all()


def test_sentence_dedup(docs, nothing):
    found = {r["doc_id"]: r for r in sd.sentence_dedup(docs, counts=True).collect()}
    texts = {r[0]: r[1] for r in corpus()}
    assert found[0]["text"] is None and found[1]["text"] == ""
    assert found[5]["text"] == texts[5] and found[6]["text"] == ""  # an exact copy goes whole
    first = texts[9].split("\n")[1]
    assert first in found[9]["text"] and all(first[5:60] not in found[i]["text"] for i in range(10, 15))
    assert all(found[i]["text"] == texts[i] for i in range(52, 92))  # texts of their own
    assert all(r["n_chars"] == len(r["text"]) for r in found.values() if r["text"] is not None)
    assert sd.sentence_dedup(docs).columns == docs.columns and sd.sentence_dedup(nothing).count() == 0



@pytest.mark.parametrize("parts", [1, 7])
def test_repeated_rows_lose_what_one_row_loses(spark, docs, parts):
    # One partition: the copies meet in one batch; several: in batches of their own.
    twice = docs.coalesce(1).union(docs.coalesce(1)).coalesce(1) if parts == 1 else docs.union(docs).repartition(parts, F.rand(1))
    for once, both in ((sd.sentence_dedup(docs, counts=True), sd.sentence_dedup(twice, counts=True)), (sx.suffix_dedup(docs, keep_bytes=False), sx.suffix_dedup(twice, keep_bytes=False))):
        key = lambda r: (r[0], str(r))
        want = sorted([tuple(r) for r in once.collect()] * 2, key=key)
        assert sorted([tuple(r) for r in both.collect()], key=key) == want


def passages(kind, rng, words, n=40, size=50):
    """Pairs of texts of their own that share ``size`` words, somewhere."""
    join = "" if kind == "spaceless" else " "
    if kind == "spaceless":
        words = [chr(c) for c in range(0x4E00, 0x5200)]
    style = {"punctuated": lambda k, w: f"{w}.", "shouted": lambda k, w: f"{w}!!" if k % 5 else w, "sixteen": lambda k, w: f"{w}." if k % 16 == 9 else w}
    out = []
    for k in range(n):
        say = lambda m: [style.get(kind, lambda k, w: w)(i, w) for i, w in enumerate(rng.choice(words, m))]
        shared = say(size)
        out.append((join.join(shared), [join.join([*say(rng.integers(1, 90)), *shared, *say(rng.integers(1, 90))]) for _ in range(2)]))
    return out


def test_short_lines_that_documents_share_are_no_passages(spark):
    """Three short sentences of a dozen words in every document stay; a copy of a text that short is no passage either."""
    head = "Home and news. All about us here. Sign in or join now.\n"
    rng = np.random.default_rng(3)
    texts = [(i, head + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 40)) + ".") for i in range(30)]
    texts += [(30, head), (31, head)]
    found = dict(rows(sd.sentence_dedup(spark.createDataFrame(texts, "doc_id long, text string"))))
    assert found == dict(texts)


@pytest.mark.parametrize("kind", ["bare", "punctuated", "shouted", "sixteen", "spaceless"])
def test_sentence_dedup_finds_passages_at_any_offset(spark, kind):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(5000)]
    pairs = passages(kind, rng, words)
    texts = [(2 * i + j, t) for i, (_, both) in enumerate(pairs) for j, t in enumerate(both)]
    found = dict(rows(sd.sentence_dedup(spark.createDataFrame(texts, "doc_id long, text string"))))
    join = "" if kind == "spaceless" else " "
    for i, (shared, both) in enumerate(pairs):
        assert found[2 * i] == both[0]
        before, after = both[1].split(shared)
        kept = found[2 * i + 1]
        assert kept.startswith(before) and kept.endswith(after)
        left = kept[len(before) : len(kept) - len(after)]
        assert (len(left) if join == "" else len(left.split())) <= 20


def test_quality_counts(docs, nothing):
    for r in qr.quality_rules(docs).collect():
        text = corpus()[r["doc_id"]][1] or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        held = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held))
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (len(words) < 20 or 100 * len(held) > 30 * len(words)) and not (r["base_failed"] and r["kept"])
    assert qr.quality_filter(docs).columns == docs.columns
    assert qr.quality_rules(nothing).count() == qr.quality_filter(nothing).count() == 0


def test_determinant_steps_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2)) @ np.array([[1.0, 0.4], [0.0, 0.7]])
    x[:120] += 12  # a fifth of the rows are far off
    df = spark.createDataFrame([("g", *map(float, v)) for v in x], "group string, x0 double, x1 double")
    got = qr.mcd_estimates(df, 2, [0.05, 0.05]).first()
    assert np.abs(np.array(got["centre"]) - x[120:].mean(axis=0)).max() < 0.1
    scatter = np.linalg.inv(np.array(got["inverse"]).reshape(2, 2))
    assert np.abs(scatter / np.cov(x[120:].T) - 1).max() < 0.3


def test_quality_rejects_outliers(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 2 + rng.integers(8))) for _ in range(500)]
    texts = [" ".join(rng.choice(words, 60 + rng.integers(200))) for _ in range(200)]
    texts += [" ".join(f"{w}###" for w in rng.choice(words, 90)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in qr.quality_rules(df).filter("kept").collect()} == set(range(200))


def test_quality_judges_small_sources_by_wider_groups(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), 2 + rng.integers(8))) for _ in range(500)]
    say = lambda mark="": " ".join(w + mark for w in rng.choice(words, 60 + rng.integers(200)))
    rows = [(say(), "en", "hot") for _ in range(300)]
    rows += [(say("###"), "en", "tiny") for _ in range(30)] + [(say(), "en", None) for _ in range(10)]  # by the whole language
    rows += [(say("###"), "xx", "other") for _ in range(20)] + [(say(), None, None) for _ in range(10)]  # by all documents
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in qr.quality_rules(df).filter("kept").collect()}
    assert kept == {i for i, (text, *_) in enumerate(rows) if "#" not in text}


def test_each_quality_statistic_rejects_alone(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefgh"), 2 + rng.integers(8))) for _ in range(500)]
    say = lambda n: rng.choice(words, n).tolist()
    clean = [" ".join(say(60 + rng.integers(200))) for _ in range(300)] + [" ".join(say(25)) for _ in range(10)]
    first, lines = say(300), [" ".join(say(7)) for _ in range(30)]
    odd = [
        " ".join(w + "#" * (k % 4 == 0) for k, w in enumerate(say(150))),  # a symbol to four words
        " ".join([*first, *first[5:55]]),  # 100 of 350 words are repeated
        "\n".join([*lines, *(x for k in range(4) for x in ("so it is", "and was"))]),  # a quarter of the lines
        " ".join(w + "abcd" for w in say(150)),
        " ".join(say(20_000)),
    ]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + odd)], "doc_id long, text string, lang string, source string")
    found = qr.quality_rules(df).collect()
    assert not any(r["base_failed"] for r in found)
    assert {r["doc_id"] for r in found if r["kept"]} == set(range(len(clean)))


def test_language(spark, docs, nothing):
    rng = np.random.default_rng(8)
    speech = {"aa": "kalimu soto veda rini".split(), "bb": "worg thrak stelm blunk".split(), "cc": "ñandú qué señor año".split()}
    texts = [(i, " ".join(rng.choice(speech[x], 12)), x) for i, x in enumerate(rng.choice(list(speech), 300))]
    texts += [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", "cc"), (903, "worg stelm", None), (904, "k", None), (None, "soto veda", "aa")]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in li.language_id(df).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items() if i is not None)
    assert all(found[i]["lang_pred"] == x for i, _, x in texts[:300])
    assert [found[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[904]["lang_pred"] in speech
    assert li.language_filter(docs).columns == docs.columns
    assert li.language_id(nothing).count() == 0


def test_language_sample_of_frequent_labels_and_repeated_rows(spark):
    """A frequent label gives exactly the rows with the smallest hashes; one row repeated often counts once."""
    rows = spark.range(20_000).selectExpr("id AS key", "if(id % 20 = 0, 'rare', 'hot') AS label", "concat('text ', id) AS text")
    copies = spark.range(3_000).selectExpr("-1L AS key", "'hot' AS label", "concat('copy ', id % 7) AS text")
    both = rows.unionByName(copies)
    sample = li.training_sample(both)
    hashes = both.select("key", "label").distinct().selectExpr("label", "xxhash64(key) AS h", "key").collect()
    for label in ("hot", "rare"):
        wanted = [r["key"] for r in sorted((r for r in hashes if r["label"] == label), key=lambda r: (r["h"], r["key"]))][: li.PER_LANGUAGE]
        found = [k for k, x in zip(sample["key"].to_pylist(), sample["label"].to_pylist(), strict=True) if x == label]
        assert sorted(found) == sorted(wanted)


def test_top_k(spark):
    rng = np.random.default_rng(9)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(260)] + [(260 + i, [0.5] * 8) for i in range(9)]
    vectors += [(300, None), (350, []), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (400, [1.0, 2.0])]
    df = spark.createDataFrame(vectors + vectors[:3], "vec_id long, embedding array<double>").withColumn("v", F.lit("x"))
    found = rows(ps.top_k(ps.whole_vectors(df), F.col("vec_id") % 50 == 0, 5))
    whole = {i: np.floor(np.array(v) * 256).astype(int) for i, v in vectors[:269]}
    want = []
    for q in range(0, 269, 50):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert found == want
    assert ps.top_k(ps.whole_vectors(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def viterbi(codes):
    score, backs = tc.FIRST + tc.SHOWN[:, codes[0]], []
    for code in codes[1:]:
        ways = score[:, None] + tc.STEP
        backs.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + tc.SHOWN[:, code]
    states = [int(score.argmax())]
    for back in reversed(backs):
        states.append(int(back[states[-1]]))
    return states[::-1]


def test_transcripts(spark, monkeypatch):
    monkeypatch.setattr(tc, "CHUNK", 4)  # conversations of many chunks
    rng = np.random.default_rng(10)
    marks = ["User: ", "### Assistant: ", "", "", "**AI**: ", "[Human] ", "System: "]
    lines = [(c, k, rng.choice(marks) + rng.choice(["how?", "so it is", "line\nand more", ""])) for c in range(6) for k in range(1 + 9 * c)]
    lines += [(None, 0, "User: x"), (9, None, None), (9, 3, "Bot: y")]
    df = spark.createDataFrame(lines + lines[:4], "conv_id long, place long, text string").withColumn("role", F.lit("z"))
    found = {}
    for r in tc.parse_transcripts(df).orderBy("turn").collect():
        found.setdefault(r["conv_id"], []).append((r["role"], r["content"]))
    for conv in {c for c, *_ in lines}:
        entries = [t or "" for c, p, t in sorted(lines, key=lambda x: -1 if x[1] is None else x[1]) if c == conv]
        turns = []
        for line, state in zip(*[(own, viterbi(codes)) for own, codes in [tc.shown(entries)]][0], strict=True):
            role, begins = tc.STATES[state]
            if begins or not turns:
                turns.append((tc.ROLES[role], []))
            turns[-1][1].append(tc.marker_of(line)[1] if begins else line)
        assert found[None if conv is None else str(conv)] == [(r, "\n".join(x).strip(" ")) for r, x in turns]
    assert tc.parse_transcripts(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "line, kind",
    [("User: hi", 2), ("### Answer", 3), ("[AI] yes", 3), ("**AI**: k", 3), ("**User:** k", 2), ("<|system|>k", 1), ("Human : x", 2)]
    + [("Answer: 42", 6), ("AI - and more", 6), ("a: b", 6), ("Question: why?", 5), ("Context: none", 4)]
    + [("AI-driven tools", 0), ("Model-based ones", 0), ("User-friendly", 0), ("A-level", 0), ("Users: many", 0), ("Context] x", 0), ("### A thing", 0)],
)
def test_markers(line, kind):
    found, rest = tc.marker_of(line)
    assert found == kind and (rest == line) == (kind in (0, 4, 5, 6))


def test_turns_hold_every_word_and_may_refuse_a_marker(spark):
    said = [
        "User: AI-driven tools are useful\nUser-friendly ones too",
        "Assistant: Model-based ones too\nAnswer: 42",
        "User: A-level\nagent - orange",
        "Assistant: so it is",
    ]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(said)], "conv_id long, place long, text string")
    turns = [(r["role"], r["content"]) for r in tc.parse_transcripts(df).orderBy("turn").collect()]
    assert turns == [(t.split(":")[0].lower(), t.split(": ", 1)[1]) for t in said]
    asked = ["Q: how?", "A: so", "Q: and when?", "A: then"]  # bare letters are believed where they fit
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(asked)], "conv_id long, place long, text string")
    turns = [(r["role"], r["content"]) for r in tc.parse_transcripts(df).orderBy("turn").collect()]
    assert turns == [("user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(asked)]


def test_roles_of_true_turns(spark):
    rng = np.random.default_rng(12)
    say = lambda: "\n".join(" ".join(rng.choice(["so", "it", "is", "and", "was"], 12)) + "." for _ in range(2 + rng.integers(2)))
    rows = [(c, k, ["user", "assistant"][k % 2], say()) for c in range(60) for k in range(2 + c % 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r["conv_id"], r["role"], r["content"]) for r in tc.parse_transcripts(tc.raw_transcripts(df)).collect()}
    assert sum((str(c), role, text) in found for c, _, role, text in rows) >= 0.95 * len(rows)


def test_piece_tokens(docs, nothing):
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = pt.encode(docs, path)
    back = {r["doc_id"]: r["text"] for r in pt.decode(encoded, path).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in corpus())
    words = pt.vocabulary(path)
    scores = dict(zip(words.pieces, zip(words.scores, words.ids, strict=True), strict=True))
    for text in ["one two three", "a  b", "worthwhile tokenisation of  words ", "é🎈x"]:
        line, best = pt.SPACE + text.replace(" ", pt.SPACE), [0.0] + [-math.inf] * (len(text) + 1)
        for i in range(len(line)):
            if line[i] not in scores:
                best[i + 1] = max(best[i + 1], best[i] + words.below * len(line[i].encode()))
            for j in range(i + 1, min(len(line), i + words.longest) + 1):
                if line[i:j] in scores:
                    best[j] = max(best[j], best[i] + scores[line[i:j]][0])
        ids = np.frombuffer(words.encode([text])[0], "<u4")
        value = {int(i): s for s, i in scores.values()} | {b: words.below for b in words.byte_ids}
        assert math.isclose(sum(value[int(i)] for i in ids), best[-1])
    assert pt.encode(nothing, path).count() == 0


def test_piece_tokens_are_those_of_sentencepiece(docs):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    found = {r["doc_id"]: r["ids"] for r in pt.encode(docs, path).collect()}
    for i, text, *_ in corpus():
        if pt.SPACE not in (text or "") and "\0" not in (text or ""):
            assert found[i] == model.encode(text or "")
    words = pt.vocabulary(path)
    texts = ["the and of that worthwhile tokenisation", "  two  spaces ", "é🎈x 漢字", "antidisestablishmentarianism" * 40, "ab" * 70 + "," * 90]
    for text, ids in zip(texts, words.tokens(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text)


def test_sharding(spark, docs, nothing, tmp_path):
    found = sh.assign(docs, 4000).collect()
    sizes, hashes = Counter(), {}
    for r in found:
        sizes[r["shard"], r["page"]] += r["bytes"]
        hashes.setdefault((r["shard"], r["page"]), set()).add(r["hash"])
        assert r["shard"] == (1 << r["depth"]) + (r["hash"] >> (sh.BITS - r["depth"]))
    assert all(n <= 4000 or len(hashes[k]) == 1 for k, n in sizes.items()) and len(found) == len(corpus())
    same = spark.createDataFrame([(1, "x" * 90, i) for i in range(50)] + [(None, None, 0)], "doc_id long, text string, depth int")
    pages = Counter((r["shard"], r["page"]) for r in sh.assign(same, 1000).collect())
    assert max(pages.values()) <= 12 and sum(pages.values()) == 51
    sh.write_shards(docs, str(tmp_path / "shards"), 4000)
    assert rows(spark.read.parquet(str(tmp_path / "shards")).select("doc_id", F.coalesce("text", F.lit("")))) == [(r[0], r[1] or "") for r in corpus()]
    sh.write_shards(same, str(tmp_path / "equal"), 1000)
    written = spark.read.parquet(str(tmp_path / "equal"))
    assert written.count() == 51 and written.select("depth").distinct().count() == 50
    equal = spark.createDataFrame([(1, "x" * 90)] * 50, "doc_id long, text string")
    sh.write_shards(equal, str(tmp_path / "same"), 1000)
    pages = spark.read.parquet(str(tmp_path / "same")).groupBy("shard", "page").count().collect()
    assert sum(r["count"] for r in pages) == 50 and max(r["count"] for r in pages) <= 12
    assert sh.assign(nothing, 1000).count() == 0


def test_shards_send_no_large_table_to_the_driver(spark, monkeypatch):
    """Sizes of nodes are far more rows than the files that they come from suggest."""
    plans = []

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, name)

    monkeypatch.setattr(sh, "materialise", written)
    monkeypatch.setattr(sh, "FEW", 100, raising=False)
    hashed = spark.range(3000).select(sh.key_hash(F.col("id")).alias("hash"), (F.col("id") % 7).alias("bytes"))
    hashed = hashed.union(spark.range(90).select(F.shiftleft("id", 36), F.lit(40).cast("long")))
    found = sh.directory(hashed, 64)
    assert len(found) > 1 and not any("Broadcast" in plan for plan in plans[:3])
    # Each hash has one bucket, the first on its way from the root that fits, or the last there is.
    places, held = {}, Counter()
    for r in hashed.collect():
        held.update({(d, r["hash"] >> (sh.BITS - d)): r["bytes"] for d in range(sh.BITS + 1)})
    for r in (r for b in found for r in b.collect()):
        places[r["bits"], r["prefix"]] = (r["depth"], r["shard"], r["paged"])
    for value in {r["hash"] for r in hashed.collect()}:
        depth = next((d for d in range(sh.BITS + 1) if held[d, value >> (sh.BITS - d)] <= 64), sh.BITS)
        node = value >> (sh.BITS - depth)
        own = [place for (bits, prefix), place in places.items() if value >> (sh.BITS - bits) == prefix]
        assert own == [(depth, (1 << depth) + node, held[depth, node] > 64)]


def linked(texts):
    sets = {}
    for i, text in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [(i, len(sets[i]), find(i)) for i in sets]


@pytest.mark.parametrize("block", [jj.INDEX_SHINGLES, 300])
def test_jaccard_join(docs, nothing, monkeypatch, block):
    monkeypatch.setattr(jj, "INDEX_SHINGLES", block)  # 300: clusters are cut into many blocks
    assert rows(jj.jaccard_join(docs)) == linked([r[:2] for r in corpus()])
    assert jj.jaccard_join(nothing).count() == 0
