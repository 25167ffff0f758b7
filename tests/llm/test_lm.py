import random
from collections import Counter

import numpy as np

from geofeat.llm import lm


def test_step_follows_the_gradient():
    rng = np.random.default_rng(0)
    net = lm.WindowNetwork.start(np.full(lm.CLASSES, 1 / lm.CLASSES))
    for rows in (8, 40):
        context, target = rng.integers(0, 7, (rows, len(lm.OFFSETS))), rng.integers(0, lm.CLASSES, rows)
        loss = lambda n: -n.log_probabilities(context)[np.arange(rows), target].mean()
        flat = net.flat().astype(np.float64)
        total, met = np.zeros((net.lines(), lm.DIM)), np.zeros(len(net.embed), int)
        net.gradient(context, target, total, met)
        grad = total.ravel() / rows
        assert met.tolist() == np.bincount(context.ravel(), minlength=len(met)).tolist()
        for i in rng.choice(np.flatnonzero(np.abs(grad) > 1e-3), 12):
            up, down = flat.copy(), flat.copy()
            up[i] += 1e-2
            down[i] -= 1e-2
            numeric = (loss(lm.WindowNetwork.of(up)) - loss(lm.WindowNetwork.of(down))) / 2e-2
            assert abs(numeric - grad[i]) < 0.05 * abs(grad[i]) + 2e-3


def test_scores_equal_a_plain_loop():
    words = lm.Alphabet({b"the": 0, b"cat": 1})
    net = lm.WindowNetwork.start(np.full(lm.CLASSES, 1 / lm.CLASSES))
    text = "The cat sat on the  mat\nthe end"
    found = words.classes(text).tolist()
    total = 0.0
    for i, c in enumerate(found):
        context = [found[i + d] if 0 <= i + d < len(found) else lm.EDGE for d in lm.OFFSETS]
        hidden = sum(net.embed[k] * net.place[j] for j, k in enumerate(context))
        z = hidden @ net.out + net.bias
        total += z[c] - np.log(np.exp(z).sum())
    n, got = lm.score_text(text, words, net)
    assert n == 8 and abs(got - total) < 1e-3


def test_large_weights_neither_overflow_nor_vanish():
    net = lm.WindowNetwork.start(np.full(lm.CLASSES, 1 / lm.CLASSES))
    net.out = net.out * 4_000
    words = lm.Alphabet({b"the": 0, b"cat": 1})
    found = words.classes("the cat sat on the mat the end of the cat")
    context = lm.windows(found, 0, len(found))
    expected = net.log_probabilities(context)[np.arange(len(found)), found].sum()
    got = net.log_likelihood(found)
    assert expected < -300 and abs(got - expected) < 1e-4 * abs(expected)
    total, met = np.zeros((net.lines(), lm.DIM)), np.zeros(len(net.embed), int)
    net.gradient(context, found, total, met)
    assert np.isfinite(total).all()


def test_trained_network_prefers_the_corpus_order(spark):
    rng = random.Random(0)
    line = "a b c d e f g h".split()
    rows = [(i, " ".join(line * rng.randint(20, 30))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    model = lm.fit(df)
    shuffled = rows[0][1].split()
    rng.shuffle(shuffled)
    n, own = lm.score_text(rows[0][1], *model)
    m, other = lm.score_text(" ".join(shuffled), *model)
    assert own / n > other / m + 0.5


def test_cases(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "one", 3), (3, "one", 3)], "doc_id long, text string, log_prob int")
    got = sorted(lm.scored(df, *lm.fit(df)).collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.log_prob, r.mean_log_prob) for r in got[:2]] == [(0, 0.0, None)] * 2
    assert got[2] == got[3] and got[2].log_prob < 0
    assert lm.scored(df.where("false"), *lm.fit(df.where("false"))).count() == 0


def test_query(spark):
    got = lm.op4_lm_score(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r.log_prob <= 0 for r in got)


def test_words_of_one_bucket_score_by_their_counts(spark):
    spread = [f"w{i}" for i in range(400)] * 3  # as many words as take all classes and rows of their own
    words = spread + ["xxabc"] * 2 + ["yyabc"]
    df = spark.createDataFrame([(0, " ".join(words))], "doc_id long, text string")
    model = lm.fit(df)
    assert len(model[0].known) == lm.KNOWN and "xxabc".encode() not in model[0].rows
    asked = spark.createDataFrame([(0, "xxabc"), (1, "yyabc"), (2, "zzabc")], "doc_id long, text string")
    twice, once, never = (r.log_prob for r in lm.scored(asked, *model).orderBy("doc_id").collect())
    assert abs(twice - once - np.log(2)) < 1e-6 and never < once - 1e-6
    plain = lm.Alphabet(model[0].known)
    b = lm.bucket(b"xxabc")
    members = [w for w in set(words) if w.encode() not in model[0].known and lm.bucket(w.encode()) == b]
    share = 2 / (sum(words.count(w) for w in members) + 1)
    assert abs(twice - lm.score_text("xxabc", plain, model[1])[1] - np.log(share)) < 1e-5


def test_alphabet_grows_with_the_corpus(spark):
    rows = [(i, " ".join(f"w{i}x{j % 100}" for j in range(1_000))) for i in range(40)]
    sizes = [len(lm.alphabet(spark.createDataFrame(rows[:n], "doc_id long, text string")).rows) for n in (4, 40)]
    assert sizes[0] == lm.KNOWN + 63 and sizes[1] == lm.KNOWN + 200


def test_every_place_trains_once(spark):
    rows = [(i, f"text {i % 30} " * (i + 1)) for i in range(40)] + [(98, ""), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = lm.alphabet(df)
    coded = [(r.turn, tuple(np.frombuffer(bytes(r.codes), np.int32).tolist())) for r in lm.coded(df, words).collect()]
    assert sorted(codes for _, codes in coded) == sorted(tuple(words.placed(t)[0].tolist()) for _, t in rows)
    assert {turn for turn, _ in coded} <= set(range(lm.ROUNDS)) and len({turn for turn, _ in coded}) > 1


def test_model_and_query_do_not_depend_on_the_split(spark):
    """1, 8 and 64 tasks give one model, which beats the classes' frequencies by far."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    means, plain = [], None
    for tasks in (1, 8, 64):
        words, net = lm.fit(docs.repartition(tasks, "doc_id"))
        scores = [lm.score_text(t, words, net) for t in texts]
        n = sum(s[0] for s in scores)
        means.append(sum(s[1] for s in scores) / n)
        bare = lm.WindowNetwork(np.zeros_like(net.embed), net.place, net.out, np.log(words.share).astype(np.float32))
        plain = sum(lm.score_text(t, words, bare)[1] for t in texts) / n
    assert max(means) - min(means) < 0.02
    assert min(means) > plain + 0.1


def test_query_equals_a_plain_loop(spark):
    """Every document's score from the definition: its words' classes by a plain softmax, their shares from plain counts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words, net = lm.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = Counter(w for t in texts.values() for w in lm.words_of(t))
    class_of = {w: words.known.get(w, lm.KNOWN + lm.bucket(w)) for w in counts}
    totals = Counter()
    for w, n in counts.items():
        totals[class_of[w]] += n
    got = {r.doc_id: r for r in lm.op4_lm_score(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys()
    for doc_id in sorted(texts)[::7]:
        own = lm.words_of(texts[doc_id])
        rows = [words.rows.get(w, class_of[w]) for w in own]
        total = 0.0
        for i, w in enumerate(own):
            hidden = sum(net.embed[rows[i + d] if 0 <= i + d < len(own) else lm.EDGE] * net.place[j] for j, d in enumerate(lm.OFFSETS))
            z = (hidden @ net.out + net.bias).astype(float)
            total += z[class_of[w]] - np.logaddexp.reduce(z)
            if w not in words.known:
                total += np.log(counts[w] / (totals[class_of[w]] + 1))
        assert got[doc_id].n_words == len(own) and abs(got[doc_id].log_prob - total) < 1e-3 * max(1, abs(total)) + 1e-2


def test_windows_of_a_part_are_those_of_the_whole():
    found = np.arange(11)
    padded = [lm.EDGE] * lm.SIDE + found.tolist() + [lm.EDGE] * lm.SIDE
    whole = [[padded[i + lm.SIDE + d] for d in lm.OFFSETS] for i in range(11)]
    for n in (1, 3, 20):
        assert np.concatenate([lm.windows(found, a, n) for a in range(0, 11, n)]).tolist() == whole


def test_long_text_and_columns_with_the_outputs_names(spark):
    df = spark.createDataFrame([(1, "word " * 60_000, 5), (2, "word other", 6)], "doc_id long, text string, N_words int")
    out = lm.scored(df, *lm.fit(df))
    assert out.columns == ["doc_id", "text", "n_words", "log_prob", "mean_log_prob"]
    assert {r.doc_id: r.n_words for r in out.collect()} == {1: 60_000, 2: 2}
