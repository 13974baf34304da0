import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinsift.llm import bytescan, leakage, packing, quality

ODD = ["", None, " \t\r\n", "﻿abc DEF_1 \r\n x.", "日本語 テスト。\nline two!\n", "a" * 5000, "worKd liKe", "\n\n.\n ?! \n", "it's the-end; of it.", "x\x00y", "THE the, (the) 'tHe'", "é.the.é"]


def counts(text, common):
    """The definition, word by word."""
    t = text or ""
    words = re.findall(r"[^ \t\r\n]+", t)
    lines = [x for x in (line.strip(" \t\r\n") for line in t.split("\n")) if x]
    cores = [re.sub(r"^[^A-Za-z]+|[^A-Za-z]+$", "", w).lower() for w in words]
    symbols = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    return (
        len(words), sum(map(len, words)), sum(c in symbols for w in words for c in w), len(lines),
        sum(line[-1] in ".!?" for line in lines), sum(c in common for c in cores),
    )


@pytest.mark.parametrize("common", [["the", "of", "like", "a"], ["the", "internationalisation", "of"], []])
@pytest.mark.parametrize("chunk", [1, 40, 10**6])
def test_counts_of_odd_texts(monkeypatch, common, chunk):
    monkeypatch.setattr(bytescan.chunks, "__defaults__", (chunk,))
    texts = [*ODD, "The internationalisation of a b. The."]
    got = quality.text_counts(pa.array(texts).slice(0), common)
    assert [tuple(int(got[c][i]) for c in quality.COUNTS) for i in range(len(texts))] == [counts(t, set(common)) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aA.é!\n\r\t -_1日K", max_size=40), max_size=8))
def test_counts_of_random_texts(texts):
    got = quality.text_counts(pa.array(texts, pa.string()), ["a", "aa"])
    assert [tuple(int(got[c][i]) for c in quality.COUNTS) for i in range(len(texts))] == [counts(t, {"a", "aa"}) for t in texts]


def test_statistics_table(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(0, "", 1)], "doc_id long, text string, n_words int")
    common = spark.createDataFrame([("the",), (None,), ("of",)], "word string")
    rows = quality.text_statistics(docs, common).collect()
    assert len(rows) == len(ODD) + 1
    assert {r["mean_word_length"] for r in rows if r["doc_id"] in (0, 1, 2)} == {None}
    assert quality.text_statistics(docs.limit(0), common).count() == 0
    with pytest.raises(ValueError):
        quality.text_statistics(docs, common, most_words=1)


def test_rule_list_recovers_bounds_and_holds_on_unseen_documents():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 80, 9000), rng.uniform(1, 14, 9000), rng.uniform(0, 0.3, 9000), rng.uniform(0, 1, 9000), rng.uniform(0, 0.6, 9000)])

    def label(v):
        return (v[:, 0] >= 30) & (v[:, 1] >= 3) & (v[:, 1] <= 10) & (v[:, 2] <= 0.1) & (v[:, 3] >= 0.5) & (v[:, 4] >= 0.2)

    rules = quality.induce_rules(x[:6000], label(x[:6000]))
    said = np.any([quality.covers(r, x[6000:], quality.FEATURES) for r in rules], axis=0)
    truth = label(x[6000:])
    assert (said & truth).sum() >= 0.99 * truth.sum() and (said & ~truth).sum() <= 0.05 * said.sum()
    assert "symbol_share <= 0.1D" in quality.rules_sql(rules) and "stop_line_share >= 0.5D" in quality.rules_sql(rules)
    assert quality.rules_sql([]) == "'other'"
    assert quality.induce_rules(x[:50], np.zeros(50, bool)) == []


def test_learned_prose_is_whole(spark):
    rng = random.Random(2)
    prose = ["The kitten of the household rested under a blanket and it was the end of the evening."] * 3
    docs = [(i, "\n".join(rng.sample(prose * 3, 4)) if i % 2 else " ".join(f"x{rng.randrange(99)}=[{i}];" for _ in range(50))) for i in range(200)] + [(900, None)]
    stats = quality.text_statistics(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("the",), ("of",), ("a",), ("it",)], "word string"))
    rules = quality.learn_prose_rules(stats, quality.prose_policy())
    from pyspark.sql import functions as F

    said = stats.where(F.expr(quality.rules_sql(rules)) == "prose")
    assert {r[0] for r in said.select("doc_id").collect()} == {i for i in range(200) if i % 2} == {r[0] for r in stats.where(quality.prose_policy()).select("doc_id").collect()}
    assert quality.learn_prose_rules(stats.limit(0), quality.prose_policy()) == []


def leaks(docs, items):
    out = set()
    for i, text in docs:
        t = leakage.item_tokens(text)
        runs = defaultdict(set)
        for j, passage in items:
            p = leakage.item_tokens(passage)
            n = min(13, len(p))
            if n:
                if n not in runs:
                    runs[n] = {tuple(t[s : s + n]) for s in range(len(t) - n + 1)}
                if any(tuple(p[s : s + n]) in runs[n] for s in range(len(p) - n + 1)):
                    out.add((i, j))
    return out


@pytest.mark.parametrize("index_items", [3, 10_000])
def test_leaks_equal_brute_force(spark, index_items):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "é", "a_b"]
    items = [(j, " ".join(rng.choices(words, k=rng.choice([1, 3, 8, 13, 14, 40])))) for j in range(20)]
    items += [(50, items[3][1]), (51, ""), (52, None), (53, "日本"), (None, "w1 w2"), (54, "same same same same same same same same same same same same same same")]
    docs = []
    for i in range(120):
        text = rng.choices(words, k=rng.randrange(0, 60))
        if i % 3 == 0:
            p = rng.choice(items[:20])[1].split()
            a = rng.randrange(len(p))
            text[10:10] = p[a : a + rng.choice([8, 12, 13, 20])] if i % 2 else p
        docs.append((i, rng.choice([" ", "\r\n", "-- "]).join(text).upper()))
    docs += [(500, None), (501, ""), (502, "x" * 100_000 + " " + items[7][1] + " " + "y " * 50_000), (0, docs[0][1]), (503, "same " * 14), (504, "same " * 12)]
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"), index_items=index_items)
    rows = [tuple(r) for r in got.select("doc_id", "item_id").collect()]
    want = leaks(docs, [x for x in items if x[0] is not None])
    assert set(rows) == want and (503, 54) in want and (504, 54) not in want
    assert Counter(rows)[docs[0][0], next((j for i, j in want if i == 0), -1)] in (0, 2)
    none = spark.createDataFrame([], "item_id long, passage string")
    assert leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


def test_hashes_do_not_depend_on_the_place():
    data = np.frombuffer(b"abcabcXabc", np.uint8)
    h = bytescan.range_hashes(data, np.array([0, 3, 7, 0]), np.array([3, 6, 10, 2]))
    assert h[0] == h[1] == h[2] != h[3]


def check_packing(rows, lengths, capacity):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    room = defaultdict(list)
    for d, n in lengths.items():
        held = sorted(pieces.pop(d), key=lambda r: r["piece_no"])
        assert [r["piece_no"] for r in held] == list(range(max(1, -(-(n or 0) // capacity))))
        at = 0
        for r in held:
            assert r["start_token"] == at
            at += r["n_tokens"]
            if n:
                room[r["container_id"]].append((r["offset_in_container"], r["n_tokens"]))
            else:
                assert r["container_id"] is None
        assert at == (n or 0)
        assert len(held) == 1 or n > capacity
    assert not pieces
    for parts in room.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert set(room) == set(range(len(room)))
    return len(room)


@pytest.mark.parametrize("rank_rows", [7, 10**6])
def test_packing_is_a_whole_partition(spark, rank_rows):
    rng = random.Random(4)
    lengths = {i: rng.choice([0, 1, 17, 17, 17, 50, 99, 100, 101, 200, 350, None, rng.randrange(1, 120)]) for i in range(700)}
    df = spark.createDataFrame([(i, n, "x") for i, n in lengths.items()], "doc_id long, n_tokens long, part string")
    used = check_packing(packing.pack_documents(df, 100, rank_rows).collect(), lengths, 100)
    total = sum(n or 0 for n in lengths.values())
    assert used <= 1.1 * total / 100 + 1
    assert packing.pack_documents(df.limit(0), 100).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_patterns_hold_the_histogram(histogram):
    patterns = packing.pack_histogram(histogram, 40)
    held = Counter()
    for count, content in patterns:
        assert count > 0 and sum(n * t for n, t in content) <= 40
        for n, t in content:
            held[n] += count * t
    assert held == Counter(histogram)


def test_tokens_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "hello world <|endoftext|>"), (4, "a" * 20_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(docs).collect()}
    assert got[1] == got[2] == 0 and got[3] > 4 and got[4] > 1000
    pieces = packing.pack_texts(docs, 256).collect()
    check_packing(pieces, got, 256)
