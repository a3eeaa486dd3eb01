"""Streams with state of their own, against plain simulations."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparkwell.streaming.ledger import ledger, preview_token
from sparkwell.streaming.sessions import replay
from sparkwell.streaming.utterances import STATE, Rules, utterances

RULES = Rules(most=9_000, least_silence=400, most_silence=1_500, sure=0.6, least_speech=300, noise=0.6)


def ticked(frames, rules):
    """Utterances by looking at each millisecond in turn."""
    out = []
    for session in {f[0] for f in frames}:
        own = {}
        for f in sorted((f for f in frames if f[0] == session), key=lambda f: f[1:3]):
            own.setdefault(f[1], []).append(f)
        start = pause = p = None
        n, noises, count = 0, [], 0

        def look(t):
            nonlocal start, count
            silence = -1 if pause is None else t - pause
            if start is not None and (t - start >= rules.most or silence >= rules.least_silence and (p is None or p >= rules.sure or silence >= rules.most_silence)):
                spoken = (t if pause is None else pause) - start
                if spoken >= rules.least_speech and not (noises and sum(noises) / len(noises) >= rules.noise):
                    count += 1
                    out.append((session, count, start * 1000, t * 1000, n, "length" if t - start >= rules.most else "silence"))
                start = None

        for t in range(0, 90_000):
            look(t)
            for _, _, _, speech, judged, noise in own.get(t, ()):
                if start is None and not speech:
                    continue
                if start is None:
                    start, pause, p, n, noises = t, None, None, 0, []
                n += 1
                noises += [] if noise is None else [noise]
                if speech:
                    pause = p = None
                elif speech is False:
                    pause = t if pause is None else pause
                    p = p if judged is None else judged
                look(t)
    return sorted(out, key=repr)


def frames_of(seed):
    r = random.Random(seed)
    out, seq = [], 0
    for session in (1, 2, 3, None):
        t = 0
        while t < 60_000:
            t += r.choice((0, 20, 100, 100, 250, 400, 500, 1_200, 2_500))
            seq += 1
            out.append((session, t, seq, r.choice((True, True, False, None)), r.choice((None, 0.2, 0.6, 0.9)), r.choice((None, 0.1, 0.5, 0.9))))
    return out


@pytest.mark.parametrize("cut", [1, 5, 12])
def test_utterances_in_micro_batches_of_any_size(spark, tmp_path, cut):
    frames = frames_of(3)
    r = random.Random(cut)
    sent = sorted(frames, key=lambda f: f[1] + r.randrange(0, 1_500))  # out of order by less than the watermark's delay
    sent.append((None, 400_000_000, 0, None, None, None))  # the last row closes what is open
    columns = ["session", "at", "seq", "speech", "judged", "noise"]
    types = [pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.bool_(), pa.float64(), pa.float64()]
    size = -(-len(sent) // cut)
    for k in range(cut):
        part = [(f[0], f[1] * 1000, *f[2:]) for f in sent[k * size:(k + 1) * size]] + ([(1, None, 0, True, None, None)] if k == 0 else [])
        at = f"{tmp_path}/{k:03}.parquet"
        pq.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], columns), at)
        os.utime(at, (1_700_000_000 + k, 1_700_000_000 + k))
    got = replay(spark, str(tmp_path), lambda f: utterances(f, RULES, "2 seconds"), conf=STATE, files=1)
    want = ticked(frames, RULES)
    assert sorted(map(tuple, got.collect()), key=repr) == want and {w[-1] for w in want} == {"length", "silence"}


def folded_ledger(actions):
    """Outcomes of actions in the order of their times, as plain dictionaries of the whole store."""
    goods, carts, shown, past, out = {}, {}, {}, {}, []
    for a in sorted(actions, key=lambda a: (a["shop"], a["at"], a["seq"])):
        shop, who, what, name, n = a["shop"], (a["shop"], a["session"]), (a["shop"], a["product"]), a["name"], a["quantity"]
        cart, again = carts.setdefault(who, {}), False
        worth = lambda c: sum(q * p for q, p in c.values())
        if name == "restock":
            goods[what] = [a["unit"], a["price"], goods.get(what, (0, 0, 0))[2] + n]
            out.append((shop, a["seq"], "restocked", 0, False))
            continue
        key = (who, "confirm", a["token"]) if name == "confirm" else (who, a["turn"], name, a["product"], n, a["unit"])
        if name != "checkout" and key in past:
            outcome, total, again = *past[key], True
        elif name == "add":
            if what not in goods:
                outcome = "unknown_product"
            elif n is None or n < 1 or n > 1000:
                outcome = "invalid_quantity"
            elif goods[what][0] != a["unit"]:
                outcome = "unit_mismatch"
            elif cart.get(a["product"], (0, 0))[0] + n > goods[what][2]:
                outcome = "insufficient_stock"
            else:
                outcome = "added"
                before = cart.get(a["product"], (0, goods[what][1]))
                cart[a["product"]] = (before[0] + n, before[1])
                shown.pop(who, None)
            total = worth(cart)
        elif name == "remove":
            if a["product"] not in cart:
                outcome = "unknown_line"
            elif n is not None and not 1 <= n <= cart[a["product"]][0]:
                outcome = "invalid_quantity"
            else:
                outcome = "removed"
                q, p = cart.pop(a["product"])
                if n is not None and q > n:
                    cart[a["product"]] = (q - n, p)
                shown.pop(who, None)
            total = worth(cart)
        elif name == "checkout":
            outcome, total = ("preview", worth(cart)) if cart else ("empty_cart", 0)
            if cart:
                shown[who] = preview_token(a["session"], a["turn"]), dict(cart)
        else:
            total = worth(cart)
            if who not in shown or shown[who][0] != a["token"] or shown[who][1] != cart:
                outcome = "stale_checkout"
            elif any(goods[shop, p][2] < q for p, (q, _) in cart.items()):
                outcome = "insufficient_stock"
            else:
                outcome = "order"
                for p, (q, _) in cart.items():
                    goods[shop, p][2] -= q
                carts[who] = {}
                del shown[who]
        past.setdefault(key, (outcome, total))
        out.append((shop, a["seq"], outcome, total, again))
    return out


def some_actions(seed):
    r = random.Random(seed)
    out, at = [], 0
    for seq in range(600):
        at += r.choice((0, 10, 400, 900))
        session = f"s{r.randrange(4)}"
        name = r.choice(("restock", "add", "add", "add", "remove", "checkout", "confirm"))
        turn = f"t{seq // 6}"
        a = dict(shop=r.randrange(3), at=at, seq=seq, session=session, turn=turn, name=name, product=r.choice("abc"), quantity=r.choice((1, 2, 3, 5, 0, 1001) if name == "add" else (None, 1, 2)), unit=r.choice(("box", "box", "box", "kg")), price=None, token=None)
        if name == "restock":
            a |= dict(session=None, turn=None, quantity=r.randrange(12), unit="box", price=r.randrange(1, 50))
        if name in ("checkout", "confirm"):
            a |= dict(product=None, quantity=None, unit=None)
        if name == "confirm":
            a["token"] = preview_token(session, r.choice((turn, f"t{seq // 6 - 1}")))
        out.append(a)
        if r.random() < 0.3:  # sent again, later or much later
            out.append(out[r.randrange(len(out))] | dict(at=at + r.choice((0, 5, 800)), seq=10_000 + seq))
    return out


@pytest.mark.parametrize("cut", [1, 6])
def test_ledger_in_any_order_and_micro_batches(spark, tmp_path, cut):
    actions = some_actions(11)
    r = random.Random(cut)
    sent = sorted(actions, key=lambda a: a["at"] + r.randrange(0, 1_500))
    odd = dict.fromkeys(actions[0])
    sent += [odd | dict(shop=1, at=10**9, name="other", seq=0), odd | dict(shop=1, seq=1, name="add", session="s1"), odd | dict(shop=1, at=10**9, seq=2, name="add")]
    sent.append(odd | dict(shop=0, at=2 * 10**9, seq=-1, name="checkout", session="end", turn="end"))
    kinds = dict(shop=pa.int64(), at=pa.timestamp("us", "UTC"), seq=pa.int64(), quantity=pa.int64(), price=pa.int64())
    size = -(-len(sent) // cut)
    for k in range(cut):
        part = sent[k * size:(k + 1) * size]
        at = f"{tmp_path}/{k:03}.parquet"
        pq.write_table(pa.table({c: pa.array([a[c] * 1000 if c == "at" and a[c] is not None else a[c] for a in part], kinds.get(c, pa.string())) for c in odd}), at)
        os.utime(at, (1_700_000_000 + k, 1_700_000_000 + k))
    got = replay(spark, str(tmp_path), lambda a: ledger(a, "2 seconds"), conf=STATE, files=1).select("shop", "seq", "outcome", "total", "repeated").collect()
    want = folded_ledger(actions)
    assert sorted(map(tuple, got)) == sorted(want)
    assert {w[2] for w in want} >= {"order", "stale_checkout", "insufficient_stock", "unit_mismatch", "invalid_quantity", "unknown_line", "preview"} and any(w[4] for w in want)
