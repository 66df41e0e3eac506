import hashlib
import json
import pathlib
import time

import numpy as np
import pytest
from hypothesis import given, strategies as st

from anchorage import session
from anchorage.llm import chat, cotraining, perplexity, toxicity, wordmodel


def test_counts_by_hand():
    text = "a b c\na b c\n\nd #% e"
    words = text.split()
    windows = list(zip(words, words[1:], words[2:]))
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    assert perplexity.counts(text) == (9, 10, 2, 1, len(marked))
    assert perplexity.counts("") == (0, 0, 0, 0, 0)


def test_model_is_a_distribution(docs):
    rows = docs([(i, f"some plain text number {i} that has words in it") for i in range(40)])
    model = perplexity.train(perplexity.grams(rows).persist())
    for context in ("som", "zzz", "t n"):
        marks = perplexity.classes(context)[-3:]
        keys = np.array([int(marks[0]) << 18 | int(marks[1]) << 12 | int(marks[2]) << 6 | c for c in range(64)], np.int32)
        assert np.exp(model.score(keys)).sum() == pytest.approx(1, abs=1e-4)


def test_rules_keep_plain_and_drop_odd(docs, none):
    plain = [(i, " ".join(f"word{(i * j) % 97} text{(i + j * j) % 89} here{(i * 7 + j) % 83}" for j in range(20))) for i in range(60)]
    noise = "".join(chr(33 + (7 * i * i) % 60) + " " for i in range(300))
    got = {r["doc_id"]: r for r in perplexity.judge(docs([*plain, (100, noise), (101, None), (102, "no " * 80)])).collect()}
    assert sum(got[i]["kept"] for i in range(60)) >= 58 and not any(got[i]["kept"] for i in (100, 101, 102))
    kept = {r["doc_id"] for r in perplexity.passing(docs([*plain, (100, noise), (101, None), (102, "no " * 80)])).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}
    assert perplexity.judge(none).count() == 0 and perplexity.passing(none).count() == 0


def test_shuffled_words_are_rejected_and_the_word_model_grows(docs):
    rng = np.random.default_rng(3)
    turns = [rng.permutation(300) for _ in range(3)]
    plain = []
    for i in range(200):
        word, said = int(rng.integers(300)), []
        for _ in range(120):
            said.append(f"w{word}")
            word = int(turns[rng.integers(3)][word])
        plain.append((i, " ".join(said)))
    shuffled = [(1000 + i, " ".join(rng.permutation(t.split()))) for i, t in plain[:10]]
    got = {r["doc_id"]: r["kept"] for r in perplexity.judge(docs(plain + shuffled)).collect()}
    assert sum(got[i] for i, _ in plain) >= 190 and not any(got[i] for i, _ in shuffled)
    kept = {r["doc_id"] for r in perplexity.passing(docs(plain + shuffled)).collect()}
    assert kept == {i for i, k in got.items() if k}
    more = [(i, t.replace("w", "v")) for i, t in plain]
    assert wordmodel.pairs(docs(plain + more)).count() > 1.9 * wordmodel.pairs(docs(plain)).count()


def test_batches_are_answered_with_the_counts_of_all_texts(docs, monkeypatch):
    monkeypatch.setattr(wordmodel, "PART", 500)
    rng = np.random.default_rng(5)
    rows = docs([(i, " ".join(f"w{k}" for k in (rng.random(60) ** 3 * 400).astype(int))) for i in range(200)] + [(900, None), (901, " ")])
    batches, counted, said, n_tokens, n_words = wordmodel.answers(rows.repartition(6))
    plain = {(r["before"], r["word"]): r["n"] for r in wordmodel.pairs(rows).collect()}
    start = int(wordmodel.START.astype(np.int64))
    assert n_tokens == sum(plain.values()) == 200 * 60 and n_words == len({w for _, w in plain}) and batches.count() > 1
    heard = {}
    for r in counted.unionByName(said).orderBy("part").collect():
        heard.setdefault((r["batch"], r["kind"]), []).append((r["kind"], r["payload"]))
    firsts = 0
    for r in batches.collect():
        own = wordmodel.Batch(r["payload"])
        hashed = own.hashes.view(np.int64)
        place = {int(g): (int(hashed[b]), int(hashed[w])) for g, b, w in zip(own.grams(), own.before, own.at)}
        (pair,) = wordmodel._answers(heard[r["batch"], wordmodel.PAIRS], wordmodel.PAIRS, 1)
        assert [plain[place[g]] for g in sorted(place)] == (pair >> 1).tolist()
        firsts += int((pair & 1).sum())
        word, last, again = wordmodel._answers(heard[r["batch"], wordmodel.WORDS], wordmodel.WORDS, 3)
        tokens = word - last
        kinds = tokens - again
        for k, h in enumerate(np.sort(own.hashes).view(np.int64).tolist()):
            after = [n for (b, _), n in plain.items() if b == h]
            assert (tokens[k], kinds[k], word[k]) == (sum(after), len(after), sum(n for (_, w), n in plain.items() if w == h))
            assert h != start or (tokens[k], word[k]) == (200, 0)
    assert firsts == len(plain)


@given(st.lists(st.text(st.sampled_from("aB\u0130\u00e9 \t\n\x0b\x0c\r\x1c\x85\xa0\0\U0001f600"), max_size=12), min_size=1, max_size=5))
def test_words_are_split_alike(texts):
    n, words = wordmodel.split_words(texts)
    want = [wordmodel.words_of(t) for t in texts]
    assert n.tolist() == [len(w) for w in want] and [w.encode() for w in words.to_pylist()] == [x for w in want for x in w]


def test_word_model_stores_less_than_a_hash_for_each_pair(docs, spark):
    rng = np.random.default_rng(7)
    rows = docs([(i, " ".join(f"w{k}" for k in rng.integers(0, 3000, 1000))) for i in range(300)]).repartition(4).persist()
    model = perplexity.train(perplexity.grams(rows).persist())
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.iterdir())
    assert wordmodel.word_scores(rows, model).count() == 300
    stored = sum(f.stat().st_size for x in set(folder.iterdir()) - before for f in x.rglob("*.parquet"))
    assert stored < 8 * wordmodel.pairs(rows).count()


def test_shuffle_files_of_a_stage_are_removed(spark):
    held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in held.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    before = shuffled()
    rows = session.stage(spark.range(1000).repartition(3, "id"), "freed", freed=True)
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and rows.count() == 1000
    session.stage(spark.range(1000).repartition(3, "id"), "plain")
    assert shuffled() - before


def test_known_contexts_score_as_searched_ones():
    rng = np.random.default_rng(2)
    own = [np.unique(rng.integers(0, 64**k, 900)).astype(np.int32) for k in range(1, 5)]
    model = perplexity.Model(own, [rng.random(k.size).astype(np.float32) for k in own], [], [])
    model.contexts = [np.unique(k >> 6) for k in own]
    model.weights = [rng.random(k.size).astype(np.float32) for k in model.contexts]
    wanted = np.concatenate([own[3], rng.integers(0, 64**4, 5000).astype(np.int32)])
    assert (model.score(wanted) == model._searched(wanted)).all()


def test_word_probabilities_by_hand():
    # a pair said 5 times, once by the text itself; 10 tokens of 4 kinds after its first word, 8 of its word; 100 tokens, 20 words
    model, own = np.array([[5], [10], [4], [8]]), np.array([[1], [2], [1]])
    word = (7 - 0.75 + 0.75 * 20 * np.exp(-3)) / 100
    want = (4 - 0.75 + 0.75 * 4 * word) / 8
    assert wordmodel.log_p(model, own, np.array([-3.0]), 100, 20)[0] == pytest.approx(np.log(want))


def labelled(docs, spark):
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(f"t{(i * k) % 97}" for k in range(1, 30)) + (" You idiots!" if bad else "")))
        marks.append((i, int(not bad), int(bad)))
    return docs(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(docs, spark, odd, none):
    rows, labels = labelled(docs, spark)
    net = toxicity.train(rows, labels)
    got = toxicity.classify(rows, net).withColumn("out", toxicity.held_out()).where("out").collect()
    assert len(got) > 40 and all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got)
    assert toxicity.classify(odd, net).where("score between 0 and 1").count() == odd.count()
    assert {r["doc_id"] for r in toxicity.without_toxic(rows, net).collect()} == {i for i in range(400) if i % 4}
    assert toxicity.classify(none, net).count() == 0
    assert toxicity.classify(odd, toxicity.train(odd, labels.where("false"))).where("score = 0.5").count() == odd.count()


def test_copies_do_not_fill_the_toxicity_sample(docs, spark, monkeypatch):
    rows, labels = labelled(docs, spark)
    copies = docs([(1000 + k * 50 + i, f"the clean text {k} that is often said") for k in range(8) for i in range(50)])
    more = spark.range(1000, 1400).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE", 40)
    monkeypatch.setattr(toxicity, "pieces_of", lambda words: seen.append(words))
    monkeypatch.setattr(toxicity, "fit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        toxicity.train(rows.unionByName(copies), labels.unionByName(more))
    assert len(seen) == 80


def test_toxicity_learns_from_rows_beyond_the_sample(docs, spark, monkeypatch):
    rows, labels = labelled(docs, spark)
    said = [(1000 + i, f"plain talk of day {i} and {'zorbish' if i % 5 == 0 else 'friend'}") for i in range(60)]
    marks = spark.createDataFrame([(1000 + i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", 5)
    monkeypatch.setattr(toxicity, "STEPS", 300)
    net = toxicity.train(rows.unionByName(docs(said)), labels.unionByName(marks))
    assert toxicity.pieces_of(["zorbish"])[0, 0] in net.known
    # rows past the first weights move the network
    monkeypatch.setattr(toxicity, "PASSES", 0)
    before = toxicity.train(rows.unionByName(docs(said)), labels.unionByName(marks))
    at = toxicity.Rows(net.known).of_texts(["zorbish"])[0][0, 0]
    assert (net.known == before.known).all() and (net.table[at] != before.table[at]).any()


def test_toxicity_thresholds_count_every_row(spark):
    net = toxicity.Network.fresh(np.unique(toxicity.pieces_of([f"w{i}" for i in range(50)])).astype(np.uint32)[1:], 3)
    net.table *= 40
    said = [(f"w{i % 50} w{i * 7 % 50}", "en" if i % 3 else None, int(i % 50 < 20)) for i in range(3000)] + [("w1", "fr", 1)] * 5
    got = toxicity.thresholds(spark.createDataFrame(said, "text string, lang string, toxic int").repartition(3), net)
    lookup = toxicity.Rows(net.known)
    score = np.floor(net.scores(lookup.of_texts([t for t, _, _ in said])) * toxicity.SCALE) / toxicity.SCALE
    assert set(got) == {"en", ""}  # five toxic rows tell nothing
    for lang in got:
        own = [(s, y) for s, (_, x, y) in zip(score, said) if (x or "") == lang]
        enough = [s for s, _ in own if s >= toxicity.LEAST and 10 * sum(y for t, y in own if t >= s) >= 9 * sum(t >= s for t, _ in own)]
        least = min(enough, default=None)
        assert got[lang] == 0.5 if least is None else got[lang] <= least


def test_cotraining(docs, spark, odd, none):
    rows, labels = labelled(docs, spark)
    pages = spark.createDataFrame([(1, "https://a.b/c?d", "<p>x<a href=1>"), (2, None, None)], "page_id long, url string, html string")
    got = cotraining.classify(rows, pages, labels).collect()
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in got) > 380
    assert cotraining.classify(odd, pages, labels).count() == odd.count()
    assert cotraining.classify(none, pages, labels).count() == 0


def test_cotraining_searches_every_unlabelled_row(spark):
    # 12,000 copies of one row and a few others, one of which is the surest
    one = [0.0] * 14
    rows = [(one, [0.0] * 8, [1, 65, 129])] * 12_000 + [([float(i)] + one[1:], [float(i)] * 8, [i % 64, 65, 129]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "content array<double>, numbers array<double>, buckets array<int>")
    pool = cotraining.Unlabelled(df)
    assert pool.n == 40
    content = np.zeros(28)
    content[0] = 0.5
    text = cotraining.Logistic(np.zeros(28), np.ones(28), np.append(0.0, content))
    meta = cotraining.Logistic(np.zeros(200), np.ones(200), np.zeros(201))
    first = pool.surest([text, meta], [set(), set()])
    assert len(first[1, 1.0]) == pool.most and all(r["content"][0] >= 8 for r in first[1, 1.0])
    taken = {r["key"] for r in first[1, 1.0]}
    again = pool.surest([text, meta], [set(), taken])
    assert again[1, 1.0] and not taken & {r["key"] for r in again[1, 1.0]} and not first[0, 1.0]


@given(st.text(alphabet=st.sampled_from("<|>/s[]INST\\\nab"), max_size=40))
def test_escape_is_reversible_and_leaves_no_control(text):
    own = chat.escape(text)
    assert chat.unescape(own) == text and not any(c in own for c in chat.CONTROLS)
    formatted, loss = chat.render_turn("assistant", text)
    assert chat.parse_turn(formatted) == ("assistant", text)
    assert [chat.unescape(formatted[a:b]) for a, b in loss] == [text]


def test_layouts_become_the_same_turns(spark):
    records = [
        {"conv_id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conv_id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"conv_id": 3, "prompt": "q", "completion": "a"},
        {"conv_id": 4, "instruction": "q", "input": "", "output": "a"},
        {"conv_id": 5, "instruction": "q", "output": "a"},
        {"conv_id": 6, "system": None, "prompt": "q", "response": "a"},
        {"conv_id": 7, "turn": 1, "role": "assistant", "text": "a"},
        {"conv_id": 7, "turn": 0, "role": "user", "text": "q"},
    ]
    rows = spark.createDataFrame([(json.dumps(r),) for r in records] + [(None,)], "record string")
    got = chat.digests(chat.render(chat.turns(rows))).collect()
    want = hashlib.sha256(b"user\nq\nassistant\na\n").hexdigest()
    assert sorted(r["conv_id"] for r in got) == list(range(1, 8)) and {r["turns_sha256"] for r in got} == {want}
    assert {r["loss_sha256"] for r in got} == {hashlib.sha256(b"a").hexdigest()}
    with pytest.raises(Exception, match="no mapping"):
        chat.turns(spark.createDataFrame([('{"conv_id": 1, "odd": 2}',)], "record string")).collect()
