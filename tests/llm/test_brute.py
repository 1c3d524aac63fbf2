"""The corpus operators' inner parts against plain versions of the same rule."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from rolecall.llm import decontaminate, fingerprint, packing, privacy, quality, toxicity, words

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return True


def test_base_spans_equal_the_patterns():
    rng = random.Random(11)
    parts = ["a", "B", "9", "0", "4111 1111 1111 1111", "4111-1111-1111-1111", "@", "@x", ".", "..", "-", "+", "+49", " ", "(", ")", "10.0.0.1", "256.1.1.1", "1.2.3", "a@b.c", "é", "\n", "%", "_", "12345678", "é@é.é"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 18)))
        want = [(k, *m.span()) for k, p in BASE.items() for m in re.finditer(p, text) if _passes(k, m.group())]
        assert privacy.base_spans(text) == want, text


def test_matcher_equals_plain_search():
    rng = random.Random(4)
    letters = "ab"
    lexicon = toxicity.Lexicon({f" {x} ": w for x, w in (("aab", 3.0), ("bb", 2.0))} | {" abba": 1.5, " abab": 2.5}, ["aab b", "b bb", "aab aab"], (0.0, 1.0, 0.0))
    matcher = toxicity.Matcher(lexicon)
    for _ in range(2000):
        folded = toxicity.fold(" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(9))))
        want = {}
        for term, weight in lexicon.weights.items():
            for k in range(len(folded)):
                if folded.startswith(term, k):
                    want[k + 1] = max(weight, want.get(k + 1, 0))
        for phrase in lexicon.exceptions:
            for k in range(len(folded)):
                if folded.startswith(f" {phrase} ", k):
                    want = {p: w for p, w in want.items() if not k + 1 <= p < k + len(phrase) + 2}
        assert matcher.matches(folded) == want, folded
        for place in want:
            near = folded[:place].split()[-1:], folded[place:].split()[:2]
            before, word, after = toxicity._neighbours(folded, place)
            assert ([before] if before else []) == near[0] and [x for x in (word, after) if x] == near[1]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    n_features, first, y = 5, np.array([0, 2, 3, 7]), np.array([1.0, 0.0, 1.0])
    x, weight = rng.normal(size=(7, n_features)), np.array([1.0, 2.0, 0.5])
    parts = [rng.normal(0, 0.5, s) for s in ((n_features + 1, 4), (4, 3), (4, 3), (3,), (5,))]
    model = quality.Model(np.zeros(n_features), np.ones(n_features), *parts)

    def loss():
        p = quality._forward(model, x, first)[0]
        return float((weight * -(y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / len(y))

    for part, grad in zip(parts, quality._gradient(model, x, first, y, weight), strict=True):
        for at in itertools.product(*(range(k) for k in part.shape)):
            old, step = part[at], 1e-6
            part[at] = old + step
            above = loss()
            part[at] = old - step
            numeric = (above - loss()) / (2 * step)
            part[at] = old
            assert math.isclose(numeric, grad[at], rel_tol=1e-4, abs_tol=1e-7)


def _smith_waterman(doc, item):
    best, above = 0, [0] * (len(doc) + 1)
    for w in item:
        now = [0]
        for k, d in enumerate(doc):
            now.append(max(0, above[k] + (2 if d == w else -1), above[k + 1] - 1, now[k] - 1))
        best, above = max(best, *now), now
    return best


def test_alignment_equals_the_full_table():
    rng = random.Random(2)
    for _ in range(400):
        doc, item = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        score, start, end = decontaminate.align(np.array(doc), np.array(item))
        assert score == _smith_waterman(doc, item)
        if score:
            assert score == _smith_waterman(doc[start:end], item)


@pytest.mark.parametrize(("every", "least"), [(20, 1.0), (12, 1.0), (9, 1.0), (7, 0.9)])
def test_recall_of_edited_copies(every, least):
    """Of copies with one word in ``every`` replaced at random that an exhaustive alignment finds, the share the seeds find."""
    rng = random.Random(every)
    items = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(30)]
    known = decontaminate._Items(list(enumerate(items)), 5)
    found = exhaustive = 0
    for i, item in enumerate(items):
        copy = [w if rng.randrange(every) else "edit" for w in item.split()]
        hashes = words.word_hashes([" ".join(copy).encode()], words.PUNCTUATION)[0]
        if _smith_waterman(hashes.tolist(), known.words[i].tolist()) >= 0.6 * 2 * 60:
            exhaustive += 1
            found += any(owner == i for _, owner, _, _ in decontaminate._hits(hashes, known))
    assert exhaustive >= 20 and found >= least * exhaustive


def test_placement_equals_the_rule():
    """Every level is tried; the sum of squared counts over open windows decides, the fullest wins ties."""
    rng = random.Random(6)
    packer, counts = packing.SumOfSquares(12), [0] * 13
    for k in range(800):
        size, best = rng.randrange(1, 12), None
        for level in range(12 - size, -1, -1):
            if level == 0 or counts[level]:
                after = counts.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 12
                cost = sum(c * c for c in after)
                if best is None or cost < best[0]:
                    best = cost, after
        packer.place(size, (k,))
        counts = best[1]
        assert packer.levels[1:12].tolist() == counts[1:12]


def test_common_extensions_equal_plain_comparison():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(1, 30))) for _ in range(2))
        x, y = fingerprint.Prefixes(a), fingerprint.Prefixes(b)
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        n = next((k for k, (c, d) in enumerate(zip(a[i:], b[j:])) if c != d), min(len(a) - i, len(b) - j))
        assert fingerprint.common(x, i, y, j) == n
        for k in range(min(len(a) - i, len(b) - j) + 1):
            assert fingerprint.same(x, i, y, j, k) == (a[i : i + k] == b[j : j + k])


def test_common_counts_equal_plain_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(12)]
    got = words.common_counts(sets[:5], sets[5:], columns=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    assert words.common_counts([], sets).shape == (0, 12)


def test_pruned_terms_equal_pairwise():
    import random

    from rolecall.llm import toxicity

    deal = random.Random(3)
    words = {"".join(deal.choices("ab", k=deal.randint(1, 9))) for _ in range(300)}
    terms = sorted({t for w in words for t in toxicity.features(w)})
    weights = {t: deal.choice([3.0, 3.5, 4.0, 4.5, 5.0]) for t in terms}
    kept = {t: w for t, w in weights.items() if not any(x.startswith(t) and weights[x] > w + 1 for x in terms)}
    assert toxicity._pruned(weights) == kept and 0 < len(kept) < len(terms)
    assert toxicity._pruned({}) == {}
