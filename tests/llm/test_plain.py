"""Operators without SQL, and the stages of the pipeline, against plain versions that read one text after the other."""

import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.llm import language_id as li
from wardline.llm import packing as pk
from wardline.llm import quality_rules as qr
from wardline.llm import sentence_dedup as sd
from wardline.llm import sharding as sh
from wardline.llm.blocks import blocks
from wardline.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def corpus():
    rng = np.random.default_rng(21)
    letters = {"en": "abcdefg", "de": "mnopqäöü", "xx": "rstuvwé"}
    words = {k: ["".join(rng.choice(list(v), 2 + rng.integers(7))) for _ in range(300)] for k, v in letters.items()}
    def say(lang, sentences, mark=""):
        return " ".join(" ".join(w + mark for w in rng.choice(words[lang], 5 + rng.integers(14))).capitalize() + rng.choice([".", "!", ".\n"]) for _ in range(sentences))

    passages = [say("en", 5) for _ in range(3)]
    texts = [(None, "en", "s1"), ("", "en", "s1"), (" \n\t", None, None), ("one two three.", "en", "s1"), ("12 34 % #", "xx", None)]
    for i in range(150):
        text = say("en", 4 + i % 9) + (" " + passages[i % 3] + " " + say("en", 3) if i % 5 == 0 else "")
        texts.append((text, "en", "s1" if i % 3 else "s2"))
    base = say("de", 30)
    texts += [(say("de", 4 + i % 9), "de", [None, "s1"][i % 2]) for i in range(90)]
    texts += [(base, "de", "s1"), (base, "de", "s1"), (base + " " + say("de", 1), "de", None), (say("de", 8, "##"), "de", "s1")]
    texts += [(say("xx", 5), "xx", "s3") for _ in range(20)] + [(say("xx", 6, "#$"), "xx", "s3") for _ in range(3)]
    texts += [(say("en", 900) + passages[0], "en", "s1"), ("so it is and was " * 40, "en", "s2"), (say("en", 9).replace("a", "🎈"), "en", "s1")]
    rows = [(i, *t, len(t[0] or "")) for i, t in enumerate(texts)]
    return rows + [rows[160], rows[160]] + [(None, "a text without an id, and with more than a few words in it", "en", "s1", 0)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


# -- repeated passages -----------------------------------------------------------


def word_hash(word):
    block = next(iter(blocks(pa.array([word]), lower=True)))
    return int(block.fingerprints(*block.words()[:2])[0])


def cut(text):
    """Words, where pieces begin, and whether a sentence begins there."""
    found = list(WORD.finditer(text or ""))
    words = [lower(m[0]) for m in found]
    opens = [
        k == 0 or words[k - 1][-1] in ".!?。！？" or "\n" in text[found[k - 1].end() : m.start()] for k, m in enumerate(found)
    ]
    begin, hashes = {k for k, x in enumerate(opens) if x}, [word_hash(w) for w in words]
    for k in range(len(words) - sd.NEAR + 1):
        near = hashes[k : k + sd.NEAR]
        begin.add(k + near.index(min(near)))
    pieces = sorted(begin)
    return found, words, pieces, [opens[k] for k in pieces]


def runs(words, pieces, whole):
    """First piece and end of every run of a text."""
    out, edge, ends = [], [*pieces, len(words)], {}
    sentences = [k for k, x in enumerate(whole) if x] + [len(pieces)]
    for j, begin in enumerate(pieces):
        stops = [k for k in range(len(edge)) if edge[k] >= begin + sd.ENOUGH][:1]
        if whole[j]:
            own = sentences.index(j)
            stops += [k for n, k in enumerate(sentences) if n >= own + sd.RUN and edge[k] >= begin + sd.LEAST][:1]
        if stops:
            ends[j] = min(stops)
            out.append((j, ends[j]))
    if len(words) >= sd.LEAST:
        tail = max([k for k, begin in enumerate(pieces) if begin <= len(words) - sd.ENOUGH], default=0)
        if ends.get(tail, -1) < len(pieces):
            out.append((tail, len(pieces)))
    return out


def plain_passages(rows):
    """Text, pieces and removed pieces of each document by its id."""
    first, cuts, gone = {}, {i: cut(t) for i, t in rows}, defaultdict(set)
    for i in sorted(cuts):
        _, words, pieces, whole = cuts[i]
        edge = [*pieces, len(words)]
        for at, (low, high) in enumerate(runs(words, pieces, whole)):
            if first.setdefault(tuple(words[edge[low] : edge[high]]), (i, at)) != (i, at):
                gone[i].update(range(low, high))
    out = {}
    for i, text in rows:
        found, _, pieces, _ = cuts[i]
        begin = [found[k].start() for k in pieces] + [len(text or "")]
        left = text
        for k in sorted(gone[i], reverse=True):
            left = left[: begin[k]] + left[begin[k + 1] :]
        out[i] = (left, len(pieces), len(gone[i]))
    return out


def test_passages_against_plain_version(docs, rows):
    expected = plain_passages({(r[0], r[1]) for r in rows if r[0] is not None})
    assert sum(x[2] > 0 for x in expected.values()) > 20
    found = sd.sentence_dedup(docs.withColumn("Places of repeated runs", F.lit(1)), counts=True).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0 and r["text"] == rows[-1][1]
        else:
            assert (r["text"], r["n_sentences"], r["n_removed"]) == expected[r["doc_id"]]


# -- quality -----------------------------------------------------------------------


def plain_kept(counted):
    """Distance and verdict of every row of counts (a pandas frame); NaN where the base rule failed."""
    columns, floors = [], np.array([floor for _, floor in qr._statistics()])
    words, lines = counted.n_words.clip(lower=1), counted.n_lines.clip(lower=1)
    columns += [np.log1p(counted.word_chars / words), np.log1p(counted.n_symbols / words)]
    columns += [np.arcsin(np.sqrt(counted.n_dup_lines / lines)), np.arcsin(np.sqrt(counted.n_repeat_words / words)), np.log(words)]
    x, size = np.stack(columns, axis=1), len(columns)
    passed = ~counted.base_failed.to_numpy()
    lang, source = counted.lang.fillna("null").to_numpy(), counted.source.fillna("null").to_numpy()
    out = np.full(len(x), np.nan)
    for one in {*zip(lang[passed], source[passed], strict=True)}:
        judged = passed & (lang == one[0]) & (source == one[1])
        among = judged if judged.sum() >= qr.LEAST_DOCS else passed & (lang == one[0])
        among = x[among if among.sum() >= qr.LEAST_DOCS else passed]
        centre, inverse = np.median(np.round(among, 3), axis=0), np.diag(1 / (3 * floors) ** 2)
        far = lambda v: np.maximum(np.einsum("ni,ij,nj->n", v - centre, inverse, v - centre), 0)  # noqa: B023, E731
        for step in range(qr.STEPS + 1):
            d = far(among)
            bins = np.floor(np.log2(d + 1e-6) * qr.BINS)
            below = np.array([(bins < b).sum() for b in bins])
            near, share = (below < qr.SHARE * len(d), qr.SHARE) if step < qr.STEPS else (d <= qr._bound(0.975, size), 0.975)
            centre = among[near].mean(axis=0)
            scatter = np.cov(among[near].T, bias=True) * share / qr._normal_share(qr._bound(share, size), size + 2)
            scatter += np.diag(np.maximum(floors**2 - np.diag(scatter), 0))
            inverse = np.linalg.inv(scatter)
        out[judged] = far(x[judged])
    return out, out <= qr._bound(qr.WITHIN, size)


@pytest.fixture(scope="module")
def kept(docs):
    counted = qr.text_counts(docs, ["doc_id", "lang", "source"]).toPandas()
    distance, verdict = plain_kept(counted)
    return {None if i != i else int(i): (d, bool(k)) for i, d, k in zip(counted.doc_id, distance, verdict, strict=True)}


def test_kept_against_plain_version(docs, rows, kept):
    found = qr.quality_rules(docs).collect()
    assert len(found) == len(rows) and {k for _, k in kept.values()} == {True, False}
    for r in found:
        distance, verdict = kept[r["doc_id"]]
        assert r["kept"] == verdict
        assert r["distance"] is None if np.isnan(distance) else np.isclose(r["distance"], distance, rtol=1e-5, atol=1e-6)


# -- language ------------------------------------------------------------------------


def plain_language(model, text):
    """Most likely label, its probability and whether it is rejected, gram by gram."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, True
    data, total, count = lower(text).encode(), np.zeros(model.scores.shape[1]), 0
    for n in li.GRAMS:
        for k in range(len(data) - n + 1):
            mixed = n
            for byte, factor in zip(data[k : k + n], li._FACTORS.tolist(), strict=False):
                mixed = (mixed ^ ((byte + 1) * factor & 0xFFFFFFFF)) * 0x01000193 & 0xFFFFFFFF
            total += model.scores[(mixed >> 8) % li.BUCKETS]
            count += 1
    logits = total / max(count, 1)
    logits = (logits if model.layer is None else logits @ model.layer) + model.prior
    odds = np.exp(logits / model.temperature - (logits / model.temperature).max())
    score = odds.max() / odds.sum()
    return model.languages[int(odds.argmax())], score, score < model.least


def test_language_against_plain_version(docs, rows):
    model, found = li.fit(docs), li.language_id(docs).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(found) == len(rows) and model.layer is None
    for r in found:
        label, score, rejected = plain_language(model, texts[r["doc_id"]])
        assert (r["lang_pred"], r["rejected"]) == (label, rejected) and abs(r["score"] - score) < 1e-5
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_rare_labels_among_many_are_learned(spark):
    rng = np.random.default_rng(22)
    own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(250 * 4)]
    rows = []
    for label in range(250):
        for _ in range(3 if label == 17 else 12):
            rows.append((len(rows), " ".join(rng.choice(own[4 * label : 4 * label + 4], 8)), f"l{label:03}"))
    df = spark.createDataFrame(rows, "key long, text string, label string")
    model = li.train(li.training_sample(df))
    assert len(model.languages) == 250 and model.scores.shape[1] == li.DIMENSIONS
    found = {r["key"]: r["lang_pred"] for r in li.identify(df, model, ["key"]).collect()}
    assert all(found[i] == label for i, _, label in rows if label == "l017")
    assert np.mean([found[i] == label for i, _, label in rows]) > 0.95
    for i in range(0, len(rows), 200):
        assert plain_language(model, rows[i][1])[0] == found[i]


# -- packing and shards: any column names ----------------------------------------------


def test_column_names_may_clash(spark, tmp_path):
    names = ["rank", "begin", "salt", "salt of rank", "number", "row", "place", "offset", "sequence_id", "a.b"]
    rows = [(4 if i < 60 else 2, *(["same"] * len(names))) for i in range(100)]
    df = spark.createDataFrame(rows, ["length", *names])
    found = pk.best_fit_packing(df, 6)
    assert sorted(found.columns) == sorted(df.columns)
    packed = [(r["sequence_id"], r["offset"], r["length"], r["rank"], r["a.b"]) for r in found.collect()]
    assert len(packed) == 100 and all(x[3:] == ("same", "same") for x in packed)
    held = defaultdict(list)
    for sequence, offset, length, *_ in packed:
        held[sequence].append((offset, length))
    for x in held.values():
        assert [o for o, _ in sorted(x)] == np.cumsum([0, *(n for _, n in sorted(x))])[:-1].tolist() and sum(n for _, n in x) <= 6
    # 60 of 4 with 40 of 2 beside them: 40 full sequences and 20 of 4 alone.
    assert len(held) == 60
    df = spark.createDataFrame([(i, "x" * 10, 7, 8, 9, "d") for i in range(40)], "doc_id long, text string, shard long, page long, key long, digest string")
    sh.write_shards(df, str(tmp_path / "out"), 100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*df.columns, "shard_", "page_"} and back.count() == 40
    assert back.select(*df.columns).exceptAll(df).count() == 0


# -- stages of the pipeline ----------------------------------------------------------------


def test_stages_against_plain_versions(spark, docs, rows, kept, tmp_path):
    texts = {r[0]: r[1] for r in rows}
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))
    every = sorted((r[0] for r in rows), key=lambda x: (x is None, x))
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    model = li.fit(docs)
    found = stages[0](spark, docs, "")
    assert found.columns == docs.columns and ids(found) == [i for i in every if not plain_language(model, texts[i])[2]]
    found = stages[1](spark, docs, "")
    assert found.columns == docs.columns and ids(found) == [i for i in every if kept[i][1]]

    sets = {}
    for i, text in texts.items():
        words = WORD.findall(lower(text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    copies = {i for i in sets for j in sets if i is not None and j is not None and j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert copies
    distinct = stages[2](spark, docs, "").cache()
    assert distinct.columns == docs.columns and ids(distinct) == [*sorted(i for i in texts if i is not None and i not in copies), None]

    fresh = stages[3](spark, distinct, "")
    expected = plain_passages({(i, texts[i]) for i in texts if i is not None and i not in copies})
    assert fresh.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in fresh.collect() if r["doc_id"] is not None} == {i: t for i, (t, *_) in expected.items()}

    from tokenizers import Tokenizer

    tokenizer, pieces, placed = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), defaultdict(list), defaultdict(list)
    for r in stages[4](spark, distinct, "").collect():
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == set(ids(distinct))
    for i, found in pieces.items():
        encoded = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, pk.END], "<u4")
        starts = range(0, len(encoded), pk.CAPACITY)
        own = [encoded[k : k + pk.CAPACITY] for k in starts]
        assert sorted(found) == [(n, k, len(x), zlib.crc32(x.tobytes())) for n, (k, x) in enumerate(zip(starts, own, strict=True))]
    for found in placed.values():
        assert [o for o, _ in sorted(found)] == np.cumsum([0, *(n for _, n in sorted(found))])[:-1].tolist() and sum(n for _, n in found) <= pk.CAPACITY
