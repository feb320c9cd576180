import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lumenquad.llm import quality_classifier as qc
from lumenquad.llm.quality_rules import quality_rules


def corpus(n=600, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    good = lambda: ". ".join(" ".join(word() for _ in range(r.randrange(5, 15))).capitalize() for _ in range(r.randrange(2, 12))) + "."
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.25
        text = " ".join(w + r.choice(["***", "###", "%%%"]) for w in good().split()) if bad else good()
        rows.append((i, text, f"s{i % 7}"))
        if r.random() < 0.6:
            labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (10_000, None, "s"), (10_001, "", "s"), (None, "words", None)], "doc_id long, text string, quality_score string")
    lab = spark.createDataFrame([*labels, (labels[0][0], None, 0)], "doc_id long, quality int, toxic int")
    model = qc.train(docs, lab, sample=300)
    got = qc.classify(docs, model).withColumn("held", qc.held_out(F.col("doc_id"))).collect()
    truth = {d: q for d, q, _ in labels}
    held = [(truth[r.doc_id], r.quality_kept) for r in got if r.held and r.doc_id in truth]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.97
    assert len(got) == len(rows) + 3 and all(0 <= r.quality_score <= 1 for r in got)
    assert 0.6 < model.prior < 0.9


def test_risk_and_minimum_equal_brute_force():
    """The risk from moments equals the mean of losses over rows, and no other weights have a lower one."""
    r = np.random.default_rng(3)
    n, d = 400, 5
    y = r.random(n) < 0.6
    x = np.c_[r.normal(size=(n, d)) + 0.8 * y[:, None], np.ones(n)]
    positive = y & (r.random(n) < 0.3)
    moments = lambda a: a.T @ a / len(a)
    for prior in (0.2, 0.6, 0.95):  # 0.95: the negatives' risk falls below nought
        risk = qc.Risk(moments(x[positive]), moments(x), prior)

        def brute(w, prior=prior):
            z = x @ w
            negatives = ((1 + z) ** 2 / 4).mean() - prior * ((1 + z[positive]) ** 2 / 4).mean()
            return prior * ((1 - z[positive]) ** 2 / 4).mean() + max(0.0, negatives)

        w = risk.minimum(np.eye(d + 1) * 1e-12)
        assert abs(risk.value(w) - brute(w)) < 1e-9
        for _ in range(300):
            v = w + r.normal(size=d + 1) * 10.0 ** r.uniform(-4, 0)
            assert abs(risk.value(v) - brute(v)) < 1e-9 and brute(v) >= brute(w) - 1e-7


def test_prior_without_negatives(spark):
    """Labels say nothing of the rest: the prior comes from positives and unlabelled rows."""
    rows, labels = corpus(3000, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    good = spark.createDataFrame([x for x in labels if x[1]], "doc_id long, quality int, toxic int")
    model = qc.train(docs, good)
    truth = np.mean([not any(c in t for c in "*#%") for _, t, _ in rows])
    assert abs(model.prior - truth) < 0.06
    scored = {r.doc_id: r.quality_score for r in qc.classify(docs, model).collect()}
    assert np.mean([(scored[d] >= 0.7) == (not any(c in t for c in "*#%")) for d, t, _ in rows]) > 0.97


def test_ties_and_repeated_rows(spark):
    rows, labels = corpus(300, 2)
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string")
    both = spark.createDataFrame(labels + [(d, 0, 0) for d, _, _ in labels], "doc_id long, quality int, toxic int")
    assert {r.quality_score for r in qc.classify(docs, qc.train(docs, both)).collect()} == {0.5}
    got = qc.classify(docs, qc.train(docs, spark.createDataFrame(labels + labels, "doc_id long, quality int, toxic int"))).collect()
    seen = {}
    assert len(got) == 305 and all(seen.setdefault(r.doc_id, r.quality_score) == r.quality_score for r in got)


def test_without_labels_or_rows(spark):
    rows, _ = corpus(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = qc.train(docs, none)
    assert {r.quality_score for r in qc.classify(docs, model).collect()} == {0.5}
    assert qc.classify(docs.limit(0), qc.train(docs.limit(0), none)).count() == 0


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark):
    r = random.Random(5)
    texts = [None, "", " \n\t ", "a b c a b c", "é | é\né | é\n\n", "x y " * 80] + [" ".join(r.choice(["ab", "cd", "é#", "f\n", "|", "gh", "\x0b"]) for _ in range(r.randrange(150))) for _ in range(100)]
    texts += ["junk ### " * 30] * 30 + [" ".join(f"word{r.randrange(9999)}" for _ in range(80)) for _ in range(30)]
    source = lambda i: None if i % 11 == 0 else "bad" if 106 <= i < 136 else f"h{i % 4}"
    df = spark.createDataFrame([(i, t, source(i), True) for i, t in enumerate(texts)], "doc_id long, text string, source string, kept boolean")
    got = {x.doc_id: x for x in quality_rules(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        x, want = got[i], brute(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (x.kept and x.base_failed)
    assert quality_rules(df.limit(0)).count() == 0


def test_hosts_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good if i % 20 else "short", f"fine{i % 5}") for i in range(1000)] + [(1000 + i, "short" if i % 10 else good, "foul") for i in range(200)] + [(2000, "short", "tiny"), (2001, good, "tiny")]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[1000].kept and got[1000].host_rate > 0.5 and got[1].kept
    # Two pages of a small host: its rate is drawn to that of all hosts.
    assert abs(got[2001].host_rate - 0.5) > 0.01 and got[2001].kept


def plain_verdicts(rows):
    """Verdicts of (source, rules_failed, symbols_failed, lines_failed) by domain, in plain arithmetic."""
    hosts = sorted({s for s, *_ in rows if s is not None})
    count = {s: [sum(r[0] == s for r in rows)] + [sum(r[0] == s and r[k] for r in rows) for k in (1, 2, 3)] for s in hosts}
    low, mean = {s: [] for s in hosts}, {}
    for k in (1, 2, 3):
        rates = [count[s][k] / count[s][0] for s in hosts]
        m, v = np.mean(rates), np.var(rates)
        strength = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v else 1000.0
        for s in hosts:
            size = count[s][0] + strength
            p = (count[s][k] + m * strength) / size
            low[s].append(p - 2 * np.sqrt(p * (1 - p) / (size + 1)))
            mean.setdefault(s, p)
    return {s: (mean[s], low[s][0] > 0.5, low[s][1] >= 0.01, low[s][2] >= 0.01) for s in hosts}


def test_hosts_of_mixed_quality_decide_documents(spark):
    """A habit of symbols or repeated lines drops what fails that rule; an accident of a clean host stays, and so does
    every clean document of a host that isn't bad as a whole."""
    r = random.Random(6)
    clean = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    kinds = {"clean": clean, "short": lambda: "too short", "symbols": lambda: " ".join(f"### w{r.randrange(10**6)}" for _ in range(60)), "lines": lambda: "\n".join(["again"] * 12 + [f"own line {r.randrange(10**9)} of it {k}" for k in range(4)] + [clean()])}
    mix = {"tidy": {"clean": 400, "symbols": 1, "lines": 1, "short": 8}, "wiki": {"clean": 300, "symbols": 1}, "noisy": {"clean": 150, "symbols": 60}, "forum": {"clean": 150, "lines": 40, "short": 20, "symbols": 1}, "junk": {"clean": 20, "symbols": 100, "short": 60}, "small": {"clean": 3, "symbols": 1}, None: {"clean": 20, "symbols": 5, "lines": 2}}
    rows = [(s, kind) for s, n in mix.items() for kind, k in n.items() for _ in range(k)]
    df = spark.createDataFrame([(i, kinds[kind](), s) for i, (s, kind) in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    got = {x.doc_id: x for x in quality_rules(df).collect()}
    assert len(got) == len(rows)
    want = plain_verdicts([(s, got[i].rules_failed, got[i].symbols_failed, got[i].lines_failed) for i, (s, _) in enumerate(rows)])
    decided = 0
    for i, (s, kind) in enumerate(rows):
        x = got[i]
        assert (x.base_failed, x.symbols_failed, x.lines_failed) == (kind == "short", kind == "symbols", kind == "lines"), kind
        mean, bad, habit_s, habit_l = want.get(s, (None, False, False, False))
        gone = bad or (kind == "symbols" and habit_s) or (kind == "lines" and habit_l)
        assert x.host_gone == gone and x.kept == (kind != "short" and not gone) and (mean is None or abs(x.host_rate - mean) < 1e-9)
        decided += gone and kind != "short"
    verdicts = {s: v[1:] for s, v in want.items()}
    assert verdicts["junk"][0] and not any(verdicts["tidy"]) and not any(verdicts["wiki"]) and verdicts["noisy"] == (False, True, False) and verdicts["forum"] == (False, False, True)
    assert decided == 120 + 60 + 40
