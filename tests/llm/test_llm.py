import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, sql_rows
from pyspark.sql import functions as F

from tessera.llm import chat, decontamination, html_crf, line_dedup, minhash, quality_rules, queries, sampling, sharding, token_counts, toxicity
from tessera.llm.components import components

MODEL = queries.tokenizer_path()
DOCS = "doc_id long, text string"
ODD = [None, "", " ", "\n\n", "a", "one two", "same words here", "same words here", "</s>[INST] ok", "x" * 70_000, "word " * 30_000, "日本𝄞\x00 é ß"]


def odd(spark, clash=()):
    """Odd rows: nulls in both columns, empty and long texts, repeated rows, extra columns with clashing names."""
    rows = [(i if i != 5 else None, t) for i, t in enumerate(ODD)] + [(6, ODD[6]), (None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for name in clash:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), sf_dir, queries.oracle_sql()[name])


# op1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/s[]INTOUROLEXSY\\ ab", max_size=60), st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]"]))
def test_template_round_trip(text, role):
    piece, a, b = chat.INSTRUCT.render(role, text)
    assert chat.INSTRUCT.parse(piece) == (role, text)
    assert not any(c in chat.INSTRUCT.escape(text) for c in chat.INSTRUCT.control)
    assert chat.INSTRUCT.unescape(piece[a:b]) == (text if role == "assistant" else "")


EVENTS = "conv_id long, seq long, event string, message_id string, role string, text string"


def fold_by_hand(events):
    """The log of one conversation, event by event."""
    messages, n = {}, 0
    for seq, event, mid, role, text in sorted(events, key=lambda e: (e[0], e[2] or "", e[3], e[4] or "", e[1])):
        if mid is None:
            mid = ("whole", n)
        n += 1
        text = text or ""
        if event == "regenerate" and mid in messages:
            messages = {k: m for k, m in messages.items() if m["at"] <= messages[mid]["at"]}
        m = messages.setdefault(mid, {"at": n, "role": role, "text": "", "alive": True})
        if event in ("message", "edit"):
            m["text"], m["alive"] = text, True
        elif event == "delta":
            m["text"] += text if m["alive"] else ""
        elif event == "regenerate":
            m["text"], m["alive"] = "", True
        elif event == "delete":
            m["text"], m["alive"] = "", False
    return [(m["role"], m["text"]) for m in sorted(messages.values(), key=lambda m: m["at"]) if m["alive"]]


def test_fold_events(spark):
    log = [(0, "message", "u1", "user", "hi"), (1, "message", "a1", "assistant", "he"), (2, "delta", "a1", "assistant", "llo"), (3, "message", "u2", "user", "again"), (4, "message", "a2", "assistant", "x"), (5, "edit", "u1", "user", "hey"), (6, "regenerate", "a1", "assistant", None), (7, "delta", "a1", "assistant", "bye"), (8, "message", None, "user", "whole"), (9, "message", "d", "user", "gone"), (10, "delete", "d", "user", None)]
    df = spark.createDataFrame([(1, *e) for e in log], EVENTS)
    pieces = chat.render(chat.fold(df)).orderBy("piece_no").collect()
    assert [chat.INSTRUCT.parse(p["piece"]) for p in pieces] == fold_by_hand(log) == [("user", "hey"), ("assistant", "bye"), ("user", "whole")]
    with pytest.raises(Exception, match="unknown event"):
        chat.fold(spark.createDataFrame([(1, 0, "what", None, "user", "x")], EVENTS)).collect()


def test_random_logs_against_the_fold_by_hand(spark):
    r = random.Random(8)
    convs = {}
    for c in range(400):
        ids = [None, *(f"m{k}" for k in range(r.randint(1, 6)))]
        kinds = r.choice([chat.EVENTS, ("message", "delta", "regenerate"), ("message", "regenerate", "delete", "delta")])
        convs[c] = [(r.choice([k, k, k // 2]), r.choice(kinds), r.choice(ids), r.choice(["user", "assistant"]), r.choice([None, f"t{k} ", "</s>"])) for k in range(r.randint(1, 25))]
        convs[c] = [(s, "message" if m is None else e, m, *x) for s, e, m, *x in convs[c]]
    df = spark.createDataFrame([(c, *e) for c, log in convs.items() for e in log], EVENTS)
    got = defaultdict(list)
    for p in chat.render(chat.fold(df.repartition(5))).orderBy("conv_id", "piece_no").collect():
        got[p["conv_id"]].append(chat.INSTRUCT.parse(p["piece"]))
    for c, log in convs.items():
        assert got[c] == fold_by_hand(log), log


def test_deleted_and_sent_again(spark):
    for log in ([(0, "message", "a", "user", "x"), (1, "delete", "a", "user", None), (2, "delta", "a", "user", "y")], [(0, "message", "a", "user", "q"), (1, "message", "b", "assistant", "x"), (2, "regenerate", "a", "user", None), (3, "message", None, "user", "w"), (4, "message", "b", "assistant", "y")]):
        pieces = chat.render(chat.fold(spark.createDataFrame([(1, *e) for e in log], EVENTS))).orderBy("piece_no").collect()
        assert [chat.INSTRUCT.parse(p["piece"]) for p in pieces] == fold_by_hand(log)


def test_logs_fold_to_their_turns(spark):
    turns = [(c, t // 2, r, x) for c in (1, None) for t, (r, x) in enumerate([("user", "hello there 日本"), (None, None), ("assistant", "a"), ("assistant", "a"), ("tool", "</s>"), ("user", "long " * 50)] * 3)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.logs(df)
    assert {x["event"] for x in made.select("event").distinct().collect()} == set(chat.EVENTS)
    got = defaultdict(list)
    for p in chat.render(chat.fold(made)).orderBy("conv_id", "piece_no").collect():
        got[p["conv_id"]].append(chat.INSTRUCT.parse(p["piece"]))
    for c in (1, None):
        assert got[c] == [(r, x) for _, r, x in sorted((t, r or "", x or "") for d, t, r, x in turns if d == c)]


def test_chat_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None), (1, 0, None, None, "user", None), (1, 0, None, None, "user", None), (1, 1, "message", None, None, "z" * 100_000)], EVENTS)
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(df))).collect()}
    assert got[None]["n_turns"] == 1 and got[1]["n_turns"] == 3 and got[1]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(("user\n\n" * 2 + "\n" + "z" * 100_000 + "\n").encode()).hexdigest()
    assert chat.read_back(chat.render(chat.fold(df.where("false")))).count() == 0


# op2


def test_quality_odd_rows_and_ablation(spark):
    ledger = quality_rules.measure(odd(spark, ("n_words", "failures")))
    assert ledger.count() == len(ODD) + 2
    empty = [r for r in ledger.collect() if r["n_words"] == 0]
    assert all(r["failures"] & quality_rules.BIT["few_words"] for r in empty)
    assert quality_rules.measure(odd(spark).where("false")).count() == 0
    for policy in (quality_rules.STRICT, quality_rules.LENIENT):
        kept = quality_rules.apply_policy(ledger, policy).where("kept").count()
        for r in quality_rules.ablate(ledger, policy).collect():
            without = quality_rules.Policy("x", 1, tuple(x for x in policy.rules if x != r["rule"]))
            assert r["n_kept_without"] == quality_rules.apply_policy(ledger, without).where("kept").count() >= kept


def test_quality_follows_labels(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    out = queries.op2_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in out}
    assert n[1, True] > 0.98 * (n[1, True] + n.get((1, False), 0)) and n.get((0, False), 0) > 0.5 * (n.get((0, False), 0) + n.get((0, True), 0))


# op3


def test_token_counts_match_the_library(spark, sf_dir):
    sp, sf_dir = SP, sf_dir.replace("0.001", "0.01")
    got = queries.op3_token_counts(spark, sf_dir).collect()
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(texts)
    for r in got:
        n = len(sp.encode(texts[r["doc_id"]] or ""))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((texts[r["doc_id"]] or "").encode()), n > 4096)
    out = token_counts.token_counts(odd(spark, ("n_tokens",)), MODEL).collect()
    assert sorted(r["n_tokens"] for r in out) == sorted(len(sp.encode(t or "")) for t in [*ODD, ODD[6], None])
    assert token_counts.token_counts(odd(spark).where("false"), MODEL).count() == 0


PIECES = token_counts.load_pieces(MODEL)
COUNTER = token_counts.Counter(PIECES)
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abethinor T▁ \nß日0.,<>/s", max_size=50))
def test_transducer_against_the_library(text):
    assert COUNTER.count(text) == len(SP.encode(text))


def test_state_maps_compose():
    t = token_counts.Transducer(PIECES)
    parts = ["▁the", "rein", "▁on", "ation", "s▁of"]
    enter, maps = [token_counts.BEGIN], []
    for p in parts:
        maps.append(t.chunk_map(p, enter))
        enter = [*t.by_id[:50], *(to for to, _ in maps[-1].values())]
    to, n = t.run("".join(parts))
    assert token_counts.scan(maps)[-1][token_counts.BEGIN] == (t.by_id[to], n)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abethinor T▁ \nß日0.,", max_size=80), st.integers(1, 9))
def test_blocks_of_any_size_count_the_same(text, block):
    counter = token_counts.Counter(PIECES, block)
    counter.counts.most_states = 20  # states are forgotten between blocks
    assert counter.count(text) == COUNTER.count(text) == len(SP.encode(text))


def test_long_texts_without_spaces():
    r = random.Random(4)
    for text in ("".join(r.choices("abcdefghijklmnopqrst", k=1_000_000)), "".join(r.choices("日本語一二三abc", k=300_000)), " " * 200_000, "the" * 100_000 + " " + "x" * 100_000 + " word" * 30_000):
        assert len(list(COUNTER.blocks(text))) > 3 and COUNTER.count(text) == len(SP.encode(text))


# op4


def test_passages_inside_lines_go(spark):
    r = random.Random(3)
    w = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(n))
    passages = [w(70) for _ in range(10)]
    docs = [(i, w(60) + " " + passages[i % 10] + " " + w(40) + ".\n" + w(30)) for i in range(60)] + [(100 + i, w(150)) for i in range(20)]
    docs += [(200, docs[60][1]), (201, None), (202, ""), (None, docs[61][1]), (203, "short line\nshort line")]
    out = {x["doc_id"]: x for x in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS).withColumn("n_removed", F.lit("clash"))).collect()}
    assert len(out) == len(docs)
    gone = [i for i in range(10, 60) if passages[i % 10] not in out[i]["text"]]
    assert len(gone) == 50 and all(passages[i] in out[i]["text"] for i in range(10))
    for i in gone:  # nothing else went
        left = dict(docs)[i].replace(passages[i % 10], "")
        assert Counter(out[i]["text"].split()) - Counter(left.split()) <= Counter(passages[i % 10].split()) and not Counter(left.split()) - Counter(out[i]["text"].split())
    assert all(out[i]["text"] == t for i, t in docs if i in range(100, 120)) and out[200]["text"] == "" and out[201]["text"] is None and out[None]["n_removed"] == 0 and out[203]["text"] == "short line\nshort line"
    assert line_dedup.dedup_lines(odd(spark)).count() == len(ODD) + 2 and line_dedup.dedup_lines(odd(spark).where("false")).count() == 0


def test_boundaries_resist_shifts():
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(400)).encode()
    a, b = (set(line_dedup.hashes_of(t, 8, 9)[0].tolist()) for t in (text, b"some more words before it all " + text))
    assert len(a & b) > 0.9 * len(a) > 20


def test_runs_against_brute_force(spark):
    """What goes stands earlier byte by byte, and all passages of 50 words that stand earlier go to their first and last word."""
    r = random.Random(10)
    for vocabulary, n in ((["w%d" % k for k in range(60)], 60), (["a", "bb", "c"], 25)):
        words = lambda k: [r.choice(vocabulary) for _ in range(k)]  # noqa: E731, B023
        pieces = [words(r.randint(20, 160)) for _ in range(12)]
        docs = []
        for i in range(n):
            w = []
            for _ in range(r.randint(1, 4)):
                p = r.choice(pieces)
                if r.random() < 0.1 and docs:
                    w += r.choice(docs)[1].split(" ")
                a = r.randint(0, len(p) // 2)
                w += words(r.randint(0, 30)) + p[a : a + r.randint(5, len(p))]
            docs.append((i, "".join(x + r.choice([" "] * 60 + ["\n", "  "]) for x in w) if i % 9 else r.choice([d for _, d in docs] or ["a b"])))
        out = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
        earlier: dict = {}
        for i, text in docs:  # spans of words with what stands between them, by id and place
            spans = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
            must, may = np.zeros(len(spans), bool), np.zeros(len(spans), bool)
            for size, mark in ((50, must), (16, may)):
                for k in range(len(spans) - size + 1):
                    piece = text[spans[k][0] : spans[k + size - 1][1]]
                    if earlier.setdefault(piece, (i, k)) != (i, k):
                        mark[k : k + size] = True
            # what is left, read from either end, lies outside all that must go and holds all that may not
            left = out[i].split()
            assert len(left) <= (~must).sum() and len(left) >= (~may).sum(), i
            needed = [text[a:b] for (a, b), m in zip(spans, may, strict=True) if not m]
            rest = iter(left)
            assert all(any(x == y for y in rest) for x in needed), i
            allowed = iter(text[a:b] for (a, b), m in zip(spans, must, strict=True) if not m)
            assert all(any(x == y for y in allowed) for x in left), i


def test_copies_that_differ_from_the_first_in_part_go(spark):
    r = random.Random(5)
    w = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    docs, want = [], {}
    for k in range(0, 120, 4):
        passage = w(60)
        docs += [(k, " ".join(w(30) + passage[:40] + w(30))), (k + 1, " ".join(w(20) + passage + w(20)))]
        head, tail = w(25), w(15)
        docs += [(k + 2, " ".join(head + passage + tail))]
        want[k + 2] = " ".join(head + tail)
    spaced = w(60)
    docs += [(200, "\n".join(spaced)), (201, " ".join(spaced)), (202, " ".join(spaced))]  # other white space than the first
    out = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert {i: out[i] for i in want} == want and out[202] == "" and all(out[i] == t for i, t in docs if i not in want and i != 202)


def test_passages_of_enormous_words_go(spark):
    r = random.Random(6)
    w = lambda n: " ".join("".join(r.choice("一二三四五六七八九十") for _ in range(100)) for _ in range(n))
    passage = w(60)  # 16 words are 4,815 bytes
    docs = [(1, w(5) + " " + passage), (2, passage + " tail")]
    out = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert out == {1: docs[0][1], 2: "tail"}


def test_passages_with_one_chunk_at_an_end_go(spark):
    r = random.Random(7)
    w = lambda n: " ".join("".join(r.choice("აბგდევზთ") for _ in range(12)) for _ in range(n))
    passages = [w(50) for _ in range(40)]  # 34 words are 1,257 bytes
    docs = [(i, f"{w(20)} {passages[i % 40]} {w(20)}") for i in range(80)]
    out = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert all(out[i] == t if i < 40 else out[i] == t.replace(passages[i % 40] + " ", "") for i, t in docs)


# op5


def test_samples_are_distinct_and_decode(spark):
    docs = odd(spark, ("sample", "ids"))
    out = sampling.sample_segmentations(docs.where("length(text) < 1000 or text is null"), MODEL, k=4, seed=1).collect()
    assert all(r["exact"] for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    for i, rows in by.items():
        if i not in (None, 6):
            assert len({tuple(r["ids"]) for r in rows}) == len(rows) and [r["perturbed"] for r in rows] == sorted((r["perturbed"] for r in rows), reverse=True)
        assert all(r["log_inclusion"] <= 0 for r in rows)
    assert [len(r["ids"]) for r in by[0]] == [0] and by[0][0]["log_inclusion"] == 0
    again = sampling.sample_segmentations(docs.where("length(text) < 1000 or text is null").repartition(7), MODEL, k=4, seed=1).collect()
    key = lambda r: (str(r["doc_id"]), r["sample"], tuple(r["ids"]))
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert sampling.sample_segmentations(docs.where("false"), MODEL).count() == 0


def test_sampling_follows_the_lattice():
    v = sampling.Vocabulary(MODEL)
    word, found = "▁then", {}

    def walk(i, ids, lp):
        if i == len(word):
            found[tuple(ids)] = lp
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in v.ids:
                walk(j, [*ids, v.ids[word[i:j]]], lp + 0.3 * v.weights[word[i:j]])

    walk(0, [], 0.0)
    total = math.log(sum(map(math.exp, found.values())))
    p = {k: math.exp(x - total) for k, x in found.items()}
    n = 6000
    got = sampling.sample_batch(list(range(n)), [[" then"]] * n, v, v.trie(), 2, 5, 0.3)
    first = Counter(tuple(own[0].ids.tolist()) for own, _ in got)
    assert all(abs(first[k] / n - x) < 0.03 for k, x in p.items())
    # without replacement: the second is any other in proportion
    second = Counter(tuple(own[1].ids.tolist()) for own, _ in got)
    want = {k: sum(p[j] * p[k] / (1 - p[j]) for j in p if j != k) for k in p}
    assert all(abs(second[k] / n - x) < 0.03 for k, x in want.items())
    # Horvitz and Thompson: inclusion scores weigh the samples to a total of one
    weights = [math.exp(s.logq.sum()) / -math.expm1(-math.exp(s.logq.sum() - kappa)) for own, kappa in got for s in own]
    assert abs(sum(weights) / n - 1) < 0.02


# op6


def by_hand(rows, limit):
    """Shards of (n_bytes, bits) rows by splitting bucket after bucket."""
    out, todo = {}, [("", list(range(len(rows))))]
    while todo:
        prefix, members = todo.pop()
        total = sum(rows[k][0] for k in members)
        if total <= limit or len(members) == 1:
            out |= dict.fromkeys(members, (prefix, total, total > limit))
            continue
        for bit in "01":
            if half := [k for k in members if rows[k][1][len(prefix)] == bit]:
                todo.append((prefix + bit, half))
    return out


def test_shards_against_splitting_by_hand(spark):
    r = random.Random(2)
    md5 = lambda x: "".join(f"{int(c, 16):04b}" for c in hashlib.md5(("" if x is None else str(x)).encode()).hexdigest())
    docs = [(i, "x" * r.randint(0, 400)) for i in range(400)] + [(9000, "z" * 5000), (None, None), (None, "n")] + [(7, "y" * 50)] * 60 + [(8, "q" * r.randint(1, 90)) for _ in range(80)] + [(None, None)] * 30 + [(11, "é" * 2000)] * 3
    df = spark.createDataFrame(docs, DOCS).withColumn("shard", F.lit("clash"))
    seen, rows = Counter(), []
    for i, t in docs:
        rows.append((len((t or "").encode()), md5(i) + md5(t or "") + f"{seen[i, t or '']:064b}"))
        seen[i, t or ""] += 1
    for limit, partitionings in ((2000, (5,)), (300, (1, 7))):
        want = Counter((docs[k][0], rows[k][0], *x) for k, x in by_hand(rows, limit).items())
        for parts in partitionings:
            assert Counter(map(tuple, sharding.assign_shards(df.repartition(parts), limit).collect())) == want
        names = sorted({x[2] for x in want})
        assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # prefixes of one another never are
    assert sharding.assign_shards(df.where("false"), 10).count() == 0 and sharding.assign_shards(odd(spark), 1000).count() == len(ODD) + 2


def test_shards_beyond_twenty_bits(spark, sf_dir):
    out = sharding.assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 1)  # a row, or rows without bytes, a shard
    assert_same(out, sf_dir, queries.op6_sql(1))
    deep = spark.createDataFrame([(i, "x") for i in range(40_000)], DOCS)
    assert sharding.assign_shards(deep, 1).agg(F.max(F.length("shard"))).first()[0] > 24


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i % 20, "t%d" % (i % 30) * 10) for i in range(100)] + [(None, None)], DOCS)
    sharding.write_shards(docs, str(tmp_path / "out"), 200)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.select("doc_id", "text").collect())) == Counter(map(tuple, docs.collect()))
    assert back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).where("b > 200").count() == 0


# op7


def brute(docs, width, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, width, percent):
    r = random.Random(width)
    vocabulary = ["w%d" % k for k in range(300)]
    docs = []
    for g in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(20, 120))]
        for _ in range(12):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            docs.append((len(docs), " ".join(copy) if r.random() < 0.9 else " ".join(copy).upper()))
    docs += [(1000, ""), (1001, None), (1002, "a b"), (1003, "A b"), (1004, "a b c"), (1005, " \t ")]
    r.shuffle(docs)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(spark.createDataFrame(docs, DOCS).withColumn("kept", F.lit("clash")), width, percent).collect()}
    assert got == brute(docs, width, percent)


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark):
    r = random.Random(9)
    rows = []
    for _ in range(25):
        base = [f"w{r.randrange(400)}" for _ in range(r.randint(20, 60))]
        for _ in range(r.randint(1, 5)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(400)}"
            rows.append((r.choice([None, *range(30)]), " ".join(copy)))
    rows += [(3, rows[0][1]), (3, rows[0][1]), rows[5], (None, rows[9][1]), (4, ""), (4, None), (4, "")]
    alone = brute(list(enumerate(t for _, t in rows)), 5, 80)  # each row as a document
    low = {}
    for k, (i, t) in enumerate(rows):
        if i is not None and alone[k][0]:
            low[alone[k][1]] = min(i, low.get(alone[k][1], i))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        n, group, _ = alone[k]
        c = low.get(group) if n else i
        want[i, n, c, c == i] += 1
    docs = spark.createDataFrame(rows, DOCS)
    assert Counter(map(tuple, minhash.near_duplicates(docs, 5, 80).collect())) == want
    kept = minhash.representatives(docs.withColumn("id", F.lit("clash")), 5, 80).collect()
    # one row of each group, that with the smallest id, and every row without words
    where = {t: alone[k][1] for k, (_, t) in enumerate(rows)}
    assert Counter(where[x["text"]] for x in kept if alone[where[x["text"]]][0]) == Counter({g: 1 for g in {alone[k][1] for k in range(len(rows)) if alone[k][0]}})
    assert all(x["doc_id"] == low.get(where[x["text"]]) for x in kept if alone[where[x["text"]]][0]) and sum(not (x["text"] or "").strip() for x in kept) == 3


def test_near_duplicates_odd_rows(spark):
    out = minhash.near_duplicates(odd(spark)).collect()
    assert len(out) == len(ODD) + 2
    assert {(r["doc_id"], r["component_id"]) for r in out if r["doc_id"] in (6, 7)} == {(6, 6), (7, 6)}
    assert all(r["kept"] and r["component_id"] is None for r in out if r["doc_id"] is None)
    assert minhash.near_duplicates(odd(spark).where("false")).count() == 0


def test_scheme_guarantees_pairs_within_the_threshold():
    r = np.random.RandomState(0)
    for s in (0.85, 0.8):
        scheme = minhash.Scheme(s)
        a = r.randint(0, 2**16, (200, scheme.positions)).astype(np.uint16)
        b = a.copy()
        for row in b:
            at = r.choice(scheme.positions, scheme.threshold, replace=False)
            row[at] ^= 1
        assert ((scheme.bucket_keys(a) == scheme.bucket_keys(b)).any(axis=1)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in (100, 150, 200)} == {100}


# op8


def test_held_out_pages():
    crf = html_crf.train(html_crf.labelled_pages(300))
    wrong = total = 0
    for html, labels in html_crf.labelled_pages(150, seed=77):
        got = crf.label(html_crf.blocks(html))
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong < 0.01 * total
    page = "<HTML><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class='cookie-notice'>We use cookies.</div><article><h1>T &amp; U</h1><p>One <b>two\n three</b><br>four&nbsp;five.<p>Next <a href='a>b'>link</a> text goes on here.<script>if (a<b) x('</p>')</script></article><div id=comments><div class=comment>Nice page, thanks for it!</div></div><footer>&copy; me</footer>"
    assert html_crf.extract(page, crf) == "T & U\nOne two three four five.\nNext link text goes on here."


def test_open_elements_swallow_no_page():
    crf = html_crf.train(html_crf.labelled_pages())
    article = "<article><h1>The title of it</h1><p>A first paragraph with several words.</p><p>And another one, as long as that.</p></article>"
    want = "The title of it\nA first paragraph with several words.\nAnd another one, as long as that."
    for opened in ("<video src=x>", "<object data=x>", "<select name=a><option>one", "<div><canvas></div>", "<audio controls><p>Not played.</p>", "<svg><path d='M0'/>", "<noscript><p>Please</p>"):
        assert html_crf.extract(f"<body><nav><a href=x>Menu</a></nav>{opened}{article}<video><p>No video.</p></video><footer>(c) me</footer></body>", crf) == want, opened
    assert html_crf.extract("<article><p>Before <svg><title>no</title><text>no</text></svg>and<script>if (a<b) x('</p>')</script> after it, <select><option>a<option>b</select>all one block.</p></article>", crf) == "Before and after it, all one block."


@pytest.mark.parametrize("page", ["<a '" * 250_000, "<div>" * 200_000, "<div>x" * 150_000, "<div class=ad><b>y</i>" * 50_000, "<a" * 500_000, "<!" * 500_000, "<a '\"" * 200_000 + ">", "<p x='>" * 150_000, "<!--" * 250_000, "<td>" * 250_000, "<b>" * 300_000 + "</i>" * 30_000, "<li><section></p>" * 60_000, "<a href=\"" * 100_000 + "'>", "&amp" * 250_000, "<tr><td>" * 120_000])
def test_time_in_proportion_to_a_page(page):
    import time

    began = time.perf_counter()
    html_crf.blocks(page)
    assert time.perf_counter() - began < 6  # about a second; a scan that turns back takes minutes


def test_extraction_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<" * 2000), (4, "u", "<div " + "a='" * 500), (5, "u", "plain"), (5, "u", "plain"), (6, "u", "<p>x</p>" * 20_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_crf.extract_main_text(pages).collect()
    assert len(out) == 8 and all(len(r["text"]) == r["n_chars"] for r in out)
    assert html_crf.extract_main_text(pages.where("false")).count() == 0


def test_pages_of_the_table(spark, sf_dir):
    import re
    from html import unescape

    got = {r["page_id"]: r["text"] for r in queries.op8_html_extraction(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)


# op9


ITEM = "If Alice buys 12 apples for 3 dollars each and Bob pays 5 euros, how much does Alice owe Bob after 7 days?"


def test_reparameterised_questions_leak(spark):
    other = ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "48").replace("7 days", "9 days")
    swapped = other.replace("does Carol owe Dave", "does Dave owe Carol")
    docs = spark.createDataFrame([(1, f"some words {ITEM.lower()} and more"), (2, f"Before it. {other} After it."), (3, f"Before it. {swapped}"), (4, ITEM[:50]), (5, None), (None, ITEM), (6, "### " + " ".join(w + "%%%" for w in ITEM.split())), (7, "nothing of the kind")], DOCS).withColumn("leaks", F.lit("clash"))
    bench = spark.createDataFrame([(1, ITEM), (1, "short"), (2, None), (None, "x y"), (3, ""), (4, "two words")], "item_id long, text string")
    got = {r["doc_id"]: [(x["item_id"], x["changed_slots"]) for x in r["leaks"]] for r in decontamination.find_leaks(docs, bench).collect()}
    assert got[1] == [(1, 0)] and got[2][0][0] == 1 and got[2][0][1] >= 4 and got[3] == [] and got[4] == [] and got[5] == [] and got[None] == [(1, 0)] and got[6] == [(1, 0)] and got[7] == []
    blocks = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontamination.find_leaks(docs, bench, block_rows=1).collect()}
    assert blocks == {i: [x for x, _ in v] for i, v in got.items()}
    assert decontamination.find_leaks(docs.where("false"), bench).count() == 0 and decontamination.find_leaks(docs, bench.where("false")).where("size(leaks) > 0").count() == 0
    assert decontamination.find_leaks(odd(spark), bench).count() == len(ODD) + 2


def test_names_at_sentence_beginnings(spark):
    item = "Alice has 12 apples and buys some more. Bob gives 3 of the apples to a friend. How many apples are left?"
    other = item.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "9")
    docs = spark.createDataFrame([(1, f"Before it. {other} After it."), (2, other.replace("Dave", "Carol")), (3, "Some Other Words Here.")], DOCS)
    bench = spark.createDataFrame([(1, item), (2, "New York Times")], "item_id long, text string")
    got = {r["doc_id"]: [(x["item_id"], x["changed_slots"]) for x in r["leaks"]] for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {1: [(1, 3)], 2: [], 3: []}


def test_typed_templates_against_brute_force(spark):
    """Items of words, names, numbers and units, and documents with one changed copy each; leaks by comparing all windows and slots directly."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(7))
    names, units = ["Anna", "Boris", "Chloe", "Dmitri", "Elif", "Farid"], ["km", "kg", "hours", "dollars"]
    others = {"#": [str(x) for x in range(10_000, 10_400)], "@": ["Gwen", "Hugo", "Ines", "Jorge", "Karim", "Lea"], "%": ["lb", "mph", "litres", "euros"]}

    def item():
        out = []
        for k in range(r.randint(12, 30)):
            x = r.random()
            out.append(r.choice(names) if k and x < 0.15 else str(r.randint(2, 9999)) if x < 0.3 else r.choice(units) if k and out[-1].isdigit() else word())
        return out

    def kind(words, k):
        w = words[k]
        return "#" if w.isdigit() else "@" if w in names + others["@"] else "%" if w in units + others["%"] and k and words[k - 1].isdigit() else w

    def changed(words):
        out, value = list(words), {}
        mode = r.choice(["values", "clash", "words", "none"])
        for k, w in enumerate(words):
            if kind(words, k) in "#@%" and mode != "none":
                pool = others[kind(words, k)]
                if w not in value or mode == "clash" and r.random() < 0.5:
                    value[w] = r.choice([x for x in pool if x not in value.values()] or pool)
                out[k] = value[w]
            elif mode == "words" and r.random() < 0.08:
                out[k] = word()
        return out

    def leaks(a, b, ta, tb):  # typed, or with names and units as words
        places = {}
        for i in range(len(a) - 4):
            places.setdefault(tuple(ta[i : i + 5]), i)
        hits = [(i, j) for j in range(len(b) - 4) if (i := places.get(tuple(tb[j : j + 5]))) is not None]
        there, back = {}, {}
        for i, j in hits:
            for k in range(5):
                if ta[i + k] in "#@%" and (there.setdefault(a[i + k], b[j + k]) != b[j + k] or back.setdefault(b[j + k], a[i + k]) != a[i + k]):
                    return False
        return len({i for i, _ in hits}) >= 0.8 * len(places)

    items = [item() for _ in range(150)]
    rows, want = [], {}
    for d, a in enumerate(items):
        b = [word() for _ in range(9)] + changed(a) + [word() for _ in range(9)]
        rows.append((d, " ".join(b)))
        want[d] = [d] if any(leaks(a, b, *([of(x, k) for k in range(len(x))] for x in (a, b))) for of in (kind, lambda x, k: "#" if x[k].isdigit() else x[k])) else []
    bench = spark.createDataFrame([(d, " ".join(a)) for d, a in enumerate(items)], "item_id long, text string")
    for blocks in ({}, {"block_rows": 40}):
        got = {x["doc_id"]: [y["item_id"] for y in x["leaks"]] for x in decontamination.find_leaks(spark.createDataFrame(rows, DOCS), bench, **blocks).collect()}
        assert got == want and 40 < sum(map(len, want.values())) < 130


def test_leaks_against_brute_force(spark, sf_dir):
    import re

    d = sf_dir.replace("0.001", "0.01")
    strip = lambda t: " ".join(w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() for w in (t or "").split()) if w)
    items = {r["item_id"]: strip(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    want = {r["doc_id"]: {i for i, b in items.items() if b in strip(r["text"])} for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r["doc_id"]: set(r["item_ids"]) for r in queries.op9_decontamination(spark, d).collect()}
    assert got == want


# op10


def segments_by_hand(scores):
    """All maximal segments by their definition: the best segment, then those left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[2] + 1e-12 or abs(total - best[2]) <= 1e-12 and j - i < best[1] - best[0] - 1):
                best = (i, j + 1, total)
    if best is None:
        return []
    left, right = segments_by_hand(scores[: best[0]]), segments_by_hand(scores[best[1] :])
    return [*left, best, *((s + best[1], e + best[1], t) for s, e, t in right)]


def test_maximal_segments():
    r = random.Random(4)
    for _ in range(300):
        scores = [r.uniform(-3, 2) for _ in range(r.randint(0, 25))]
        got = toxicity.maximal_segments(scores)
        want = segments_by_hand(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and np.allclose([x for *_, x in got], [x for *_, x in want])


def test_toxicity_held_out(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.1")
    rows = queries.op10_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    tp, fp, fn = (sum(r["predicted"] == a and r["toxic"] == b for r in rows) for a, b in ((1, 1), (1, 0), (0, 1)))
    assert tp > 0.85 * (tp + fn) and fp < 0.05 * (tp + fp)


def test_scores_against_brute_force(spark, sf_dir):
    """Scores of whole texts from the model alone: segments by their definition, statistics by their formulas."""
    import re

    sf_dir = sf_dir.replace("0.001", "0.01")
    model = queries.toxicity_model(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 600").select("doc_id", "text").collect()
    texts += [(-1 - k, t) for k, t in enumerate([None, "", "?!", " ".join(list(model.words)[:40]), *(" ".join(["calm"] * k + list(model.words)[:k]) for k in range(1, 9))])]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame([tuple(t) for t in texts], DOCS), model).collect()}
    hits = 0
    for i, text in texts:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        values = [max([model.words[x] for x in (w,) if x in model.words] + [s for p, s in model.beginnings.items() if w.startswith(p)], default=model.drift) for w in words]
        segments = segments_by_hand(values) if max(values, default=-1) > 0 else []
        z = sorted((model.lam * s - model.log_k - math.log(len(words)) for *_, s in segments), reverse=True)
        total = 0.0
        for r in range(1, len(z) + 1):  # -ln of e^-T T^(r-1) / (r! (r-1)!), up to the first r beyond which the sum is not positive and falls
            t = sum(z[:r])
            if t <= 0 and z[r - 1] < 0:
                break
            if t > 0:
                total = max(total, t - (r - 1) * math.log(max(t, 1.0)) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1)))
        x = model.weights[0] + model.weights[1] * math.log1p(max(0.0, *z) if z else 0.0) + model.weights[2] * math.log1p(total) + model.weights[3] * bool(segments)
        assert math.isclose(got[i]["score"], 1 / (1 + math.exp(-x)), rel_tol=1e-6, abs_tol=1e-9), (i, text)
        assert got[i]["predicted"] == (got[i]["score"] >= 0.7) and got[i]["n_segments"] == len(segments)
        hits += bool(segments)
    assert hits >= 9


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i}") for i in range(400)] + [(None, "x")], DOCS)
    labels = spark.createDataFrame([(i % 60, int(i > 100)) for i in range(180)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, F.lit(True), 30)
    assert sample.count() <= 30 and {r["toxic"] for r in sample.collect()} == {1}
    told = docs.where("doc_id is not null").select(F.concat("text", F.when(F.col("doc_id") % 2 == 1, F.lit(" nasty")).otherwise(F.lit(" fine"))).alias("text"), (F.col("doc_id") % 2).alias("toxic"))
    model = toxicity.fit(told, max_rows=100)
    assert set(model.words) == {"nasty"} and model.weights[1:] != (0.0, 0.0, 0.0)


def test_toxicity_odd_rows(spark):
    labelled = spark.createDataFrame([("you bad idiot %d" % i, 1) for i in range(30)] + [("a fine day %d" % i, 0) for i in range(200)] + [(None, 0), ("x", None)], "text string, toxic int")
    model = toxicity.fit(labelled)
    out = toxicity.score(odd(spark, ("score",)), model).collect()
    assert len(out) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in out)
    s = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([(1, "what an Idiot you are"), (2, "a fine thing")], DOCS), model).collect()}
    assert s[1] > 0.7 > s[2]
    alone = toxicity.fit(labelled.where("toxic = 0"))
    assert toxicity.score(odd(spark), alone).where("predicted = 1").count() == 0 and toxicity.fit(labelled.where("false")).words == {}
    assert toxicity.score(odd(spark).where("false"), model).count() == 0 and toxicity.without_toxic(odd(spark), model).count() == len(ODD) + 2


# the pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {r["doc_id"] for r in docs.collect()}
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert tuple(docs.columns) == c.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= seen, name
        seen = now
    out = c.encode(spark, docs, sf_dir)
    assert {r["doc_id"] for r in out.collect()} == seen and out.where("not exact").count() == 0
    assert c.run(spark, sf_dir).count() == out.count()


def test_pipeline_odd_rows(spark, sf_dir):
    import corpus_pipeline as c

    docs = odd(spark).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long"), "more": F.lit(0)})
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert tuple(out.columns) == c.COLUMNS and out.count() > 0 and stage(spark, docs.where("false"), sf_dir).count() == 0
    one = c.drop_near_duplicates(spark, docs, sf_dir).where("doc_id in (6, 7)").collect()
    assert [r["doc_id"] for r in one] == [6]


def test_sql_helper(sf_dir):
    assert sql_rows(sf_dir, "SELECT count(*) AS n FROM documents")[1][0][0] > 0


def test_near_copies_that_meet_in_rounds_lose_no_link(spark):
    """Texts of 100 words with two changed each, of which few pairs are linked; the links are those of brute force."""
    some = random.Random(11)
    texts = []
    for k in range(160):
        own = [f"w{x}" for x in range(100)]
        for at in some.sample(range(100), 2):
            own[at] = f"x{k}at{at}"
        texts.append(" ".join(own))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(98)} for t in texts]
    root = list(range(160))
    for a in range(160):
        for b in range(a):
            if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert got == dict(enumerate(root))


def test_near_texts_that_stay_apart_are_not_all_paired_up(spark, monkeypatch):
    """600 texts of 200 words with four to six changed each, few of them linked: pairs whose sets are compared."""
    some, asked, real = random.Random(1), [], minhash.map_arrow
    texts = []
    for _ in range(600):
        own = [f"w{x}" for x in range(200)]
        for _ in range(some.randint(4, 6)):
            own[some.randrange(200)] = f"x{some.random()}"
        texts.append(" ".join(own))

    def counted(rows, *more):
        if "text_a" in rows.columns:
            asked.append(rows.count())
        return real(rows, *more)

    monkeypatch.setattr(minhash, "map_arrow", counted)
    assert minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).count() == 600
    assert sum(asked) < 105_000  # of 179,700; all sets of a shingle met two, then each other: 126,016
