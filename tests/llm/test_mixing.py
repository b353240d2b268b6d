import math
import random
from collections import Counter, defaultdict

import pytest

from tallyfold.llm import mixing
from tests.llm.conftest import prose, rows, with_clashes

PRIME = 2147483647


@pytest.fixture(scope="module")
def sources(make_docs):
    rnd, sizes = random.Random(4), {"big": 120, "mid": 40, "small": 9, None: 5, "void": 2}
    docs = []
    for source, n in sizes.items():
        for _ in range(n):
            text = None if source == "void" else prose(len(docs), rnd.randint(0, 40))
            docs.append((len(docs), text, "en", source))
    return make_docs(*docs)


def mixed(key, salt):
    once = (key % PRIME * 1103515245 + salt) % PRIME
    return (once * 48271 + 12345) % PRIME * (once % 46337 + 1) % PRIME


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w) / math.log(sum(w > 0 for w in weights))


def plain(docs, target, budget=None, seed=1):
    """The same by plain loops, halving the exponent's interval one by one."""
    tokens, blocks = Counter(), defaultdict(Counter)
    found = [(d["doc_id"], d["source"], len((d["text"] or "").split())) for d in docs]
    for i, s, n in found:
        tokens[s] += n
        blocks[s][mixed(i, seed) % mixing.BLOCKS] += n
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n}

    def weights(e):
        power = {s: math.exp(math.log(p) * e) for s, p in share.items()}
        return {s: x / sum(power.values()) for s, x in power.items()}

    def flat(e):
        if target.entropy is not None:
            return entropy(weights(e).values()) >= target.entropy
        ratio = [w / share[s] for s, w in weights(e).items()]
        return max(ratio) / min(ratio) <= target.repeats

    low, high = 0.0, 1.0
    down = target.entropy is not None
    if flat(1.0 if down else 0.0):
        low = high = 1.0 if down else 0.0
    else:
        for _ in range(mixing.HALVINGS):
            middle = (low + high) / 2
            if flat(middle) == down:
                low = middle
            else:
                high = middle
    weight = weights(low if down else high)
    everything = budget or max(tokens[s] / w for s, w in weight.items())
    out = []
    for s in tokens:
        amount = math.floor(weight.get(s, 0) * everything * (1 + 1e-12) + 1e-6)
        epochs, rest = divmod(amount, tokens[s]) if tokens[s] else (1, 0)
        for b in sorted(blocks[s], key=lambda b: (mixed(b, seed + epochs), b)):
            here, rest = max(rest, 0), rest - blocks[s][b]
            own = sorted((f for f in found if f[1] == s and mixed(f[0], seed) % mixing.BLOCKS == b), key=lambda f: (mixed(f[0], seed + epochs), f[0]))
            before = 0
            for i, _, n in own:
                more = here > 0 and (here >= blocks[s][b] or before < here)
                out.append((i, s, n, epochs + more, round(weight.get(s, 0.0), 9)))
                before += n
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    ("target", "budget"),
    [
        (mixing.Target(entropy=0.9), None), (mixing.Target(entropy=1.0), None), (mixing.Target(entropy=0.1), None),
        (mixing.Target(repeats=2.0), None), (mixing.Target(repeats=1.0), None), (mixing.Target(repeats=1e9), None),
        (mixing.Target(entropy=0.95), 1000), (mixing.Target(repeats=3.0), 50),
    ],
)
def test_against_loops(sources, target, budget):
    found, expected = rows(mixing.mix_documents(sources, target, budget)), plain(sources.collect(), target, budget)
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    assert [r[4] for r in found] == pytest.approx([r[4] for r in expected], abs=1e-7)


def test_targets_are_met(sources):
    found = mixing.mix_documents(sources, mixing.Target(entropy=0.9)).collect()
    drawn, weight = Counter(), {}
    for r in found:
        drawn[r["source"]] += r["copies"] * r["n_tokens"]
        weight[r["source"]] = r["weight"]
    assert abs(entropy(weight.values()) - 0.9) < 1e-6 and min(r["copies"] for r in found) >= 1
    total = sum(drawn.values())
    assert all(abs(drawn[s] - weight[s] * total) <= 50 for s in drawn)
    twice = [r["copies"] for r in mixing.mix_documents(sources, mixing.Target(repeats=2.0)).collect()]
    assert min(twice) == 1 and max(twice) == 2


def test_drawn_rows(sources):
    counts = {r["doc_id"]: r["copies"] for r in mixing.mix_documents(sources, mixing.Target(entropy=0.95), 900).collect()}
    drawn = mixing.draw(sources, mixing.Target(entropy=0.95), 900)
    assert drawn.columns == sources.columns
    assert Counter(r["doc_id"] for r in drawn.collect()) == Counter({k: v for k, v in counts.items() if v})


def test_a_plan_too_large_to_broadcast(sources, monkeypatch):
    target = mixing.Target(entropy=0.9)
    expected = rows(mixing.mix_documents(sources, target))
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 0)
    assert rows(mixing.mix_documents(sources, target)) == expected


def test_odd_rows(odd_docs, no_docs):
    target = mixing.Target(repeats=2.0)
    df = with_clashes(odd_docs, "copies", "weight", "tokens", "share")
    assert mixing.mix_documents(df, target).count() == odd_docs.count()
    assert {r["doc_id"] for r in mixing.draw(odd_docs, target).collect()} == {r["doc_id"] for r in odd_docs.collect()}
    assert mixing.mix_documents(no_docs, target).collect() == mixing.draw(no_docs, target).collect() == []
    blank = odd_docs.where("text is null")
    assert [r["copies"] for r in mixing.mix_documents(blank, target).collect()] == [1]


def test_one_target():
    for bad in ({}, {"entropy": 0.5, "repeats": 2.0}):
        with pytest.raises(ValueError, match="either"):
            mixing.Target(**bad)


def test_no_python(sources):
    plan = mixing.mix_documents(sources, mixing.Target(entropy=0.9))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
