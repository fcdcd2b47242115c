"""Operators against plain Python on small made-up corpora with copies, near copies and passages."""

import collections
import hashlib
import importlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest

from tidemark.llm import components, decontaminate, licenses, media_shards, mixing, neardup, passages, pii, quality, sharding, token_orc

WORD = r"[^\x20\x09-\x0D]+"


def corpus(seed=0, n=90):
    """Random texts over few words; copies, near copies at many distances, shared passages, loops."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passage, line = text(40), text(9)
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and out:
            out.append(list(rng.choice(out)))
        elif kind < 0.55 and out:
            own = list(rng.choice(out))
            for _ in range(rng.randint(1, 6)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
            out.append(own)
        elif kind < 0.65:
            out.append((text(2) * 40)[: rng.randint(20, 60)])
        else:
            own = text(rng.choice([0, 1, 3, 4, 19, 20, 21, 60, 150]))
            at = rng.randint(0, len(own))
            out.append(own[:at] + (passage if rng.random() < 0.5 else line) + own[at:] if rng.random() < 0.7 else own)
    return [(k * 3, rng.choice([" ", "\n", "\t "]).join(w)) for k, w in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = re.findall(WORD, t)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(k)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "batches"), [(0, 1), (1, 2), (2, 3)])
def test_passages(spark, seed, batches):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_passages(frame(spark, rows), batches).collect()}
    want = removed(rows)
    assert got == want and sum(w[1] for w in want.values()) > 100


def test_passages_in_batches_with_compaction(spark):
    rows = corpus(3)
    index, found = passages.PassageIndex(spark, fanout=2), collections.defaultdict(set)
    texts = frame(spark, rows).selectExpr("doc_id AS id", "0 AS copy", "text")
    for k in range(4):
        part = texts.where(f"id div 3 % 90 >= {k * 23} AND id div 3 % 90 < {(k + 1) * 23}")
        for r in index.ingest(part, texts).collect():
            found[r.id].update(range(r.start, r.start + r.n + 19))
    assert len(index.runs) < 4
    assert {i: len(found[i]) for i, _ in rows} == {i: w[1] for i, w in removed(rows).items()}
    index.drop()


def test_passages_with_hot_lines_and_repeated_rows(spark, monkeypatch):
    """A line that many texts share amid their own words, and a passage of many: hot shingles are
    dealt by span; rows that occur twice are one document."""
    monkeypatch.setattr(passages, "HOT_ROWS", 20)
    rng = random.Random(12)
    words = [f"u{k}" for k in range(5000)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    line, passage = text(12), text(45)
    rows = [(k, " ".join(text(rng.randint(5, 40)) + (passage if k % 5 == 0 else line) + text(rng.randint(5, 40)))) for k in range(400)]
    twice = rows + rows[::7] + [(k, t) for k, t in rows[::7]]
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_passages(frame(spark, twice).repartition(7)).collect()}
    want = removed(rows)
    assert got == {(i, *w) for i, w in want.items()} and sum(w[1] for w in want.values()) >= 79 * 45


def classes(rows, size):
    low = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, t.translate(low))
        sets[i] = {tuple(w[a : a + size]) for a in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}, links


@pytest.mark.parametrize(("seed", "size"), [(0, 4), (4, 5)])
def test_near_duplicates(spark, seed, size):
    rows = corpus(seed, 120)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows), size).collect()}
    want, links = classes(rows, size)
    assert got == want and links > 20


def test_near_duplicates_with_large_groups(spark):
    """Over sixty near copies of one text, at distances on both sides of the limit, and as many
    texts around one passage."""
    rng = random.Random(9)
    base, passage, rows = [f"b{k}" for k in range(120)], [f"p{k}" for k in range(50)], []
    for k in range(70):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = f"e{k}x{rng.random()}"
        rows.append((k, " ".join(own)))
    for k in range(70, 140):
        extra = [f"u{k}x{j}" for j in range(rng.randint(5, 14))]
        rows.append((k, " ".join(passage + extra)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows), 4).collect()}
    assert got == classes(rows, 4)[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_beyond_the_centre(spark, seed):
    """Large groups around a base that isn't in the table: families far from any centre, drifting
    chains and cut texts of many lengths, whose links go between members only."""
    rng = random.Random(seed)
    base, rows = [f"b{k}" for k in range(130)], []
    edited = lambda own, n: [f"e{rng.random()}" if j in hit else w for hit in [set(rng.sample(range(len(own)), n))] for j, w in enumerate(own)]
    for _ in range(25):  # families: far from the base, near one another
        head = edited(base, rng.randint(4, 9))
        rows += [edited(head, rng.randint(0, 3)) for _ in range(3)]
    now = edited(base, 3)
    for _ in range(40):  # a chain that drifts away
        now = edited(now, 1)
        rows.append(now)
    for _ in range(40):  # cut and lengthened texts
        own = edited(base, rng.randint(0, 2))
        rows.append(own[rng.randint(0, 20) :] + [f"x{rng.random()}" for _ in range(rng.choice([0, 0, 10, 20]))])
    rng.shuffle(rows)
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows), 4).collect()}
    want, links = classes(rows, 4)
    assert got == want and links > 100 and len({w[1] for w in want.values()}) > 10


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def words_of(t):
    return re.findall(r"[^\W_]+", t.lower())


def test_decontamination(spark):
    rng = random.Random(5)
    words = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([6, 15, 30, 30, 50])))) for k in range(12)]
    rows = []
    for k in range(60):
        own = [rng.choice(words) for _ in range(rng.choice([3, 40, 200]))]
        if k % 3 == 0:
            copy = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = "changed"
            at = rng.randint(0, len(own))
            own = own[:at] + (copy if k % 2 else [w.upper() + "," for w in copy]) + own[at:]
        rows.append((k, " ".join(own)))
    shingles = lambda w: collections.Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
    want = set()
    for i, t in rows:
        w = words_of(t)
        for j, s in items:
            other = words_of(s)
            b = shingles(other)
            for a in range(-len(other), len(w)):
                one = shingles(w[max(a, 0) : a + len(other)])
                both, total = sum((one & b).values()), sum((one | b).values())
                if total and both * 100 >= total * 80:
                    want.add((i, j))
    got = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 10


def test_decontamination_of_reordered_items(spark):
    """Items with their parts in another order, in long texts and at the edges, against all windows."""
    rng = random.Random(8)
    words = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([40, 40, 45, 50, 59, 59, 59, 41, 44, 58])]
    rows = []
    for k in range(40):
        copy = items[k % 10][1].split()
        cut = len(copy) // rng.choice([2, 2, 3])
        own = [rng.choice(words) for _ in range(rng.choice([0, 30, 100]))]
        at = rng.choice([0, len(own), rng.randint(0, len(own))])
        rows.append((k, " ".join(own[:at] + copy[cut:] + copy[:cut] + own[at:])))
    shingles = lambda w: collections.Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
    want = {}
    for i, t in rows:
        w = words_of(t)
        for j, s in items:
            other = words_of(s)
            b = shingles(other)
            for a in range(-len(other), len(w)):
                one = shingles(w[max(a, 0) : a + len(other)])
                both, total = sum((one & b).values()), sum((one | b).values())
                if total and both * 100 >= total * 80:
                    want[i, j] = max(want.get((i, j), (0,)), (both / total, -max(a, 0)))
    got = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, -r.start) for r in got} == want and len(want) > 30


def test_recall_of_decontamination(spark):
    """Items changed within, cut and lengthened at the edges down to the limit: nearly all pairs
    that brute force finds; and short items as they stand."""
    rng = random.Random(9)
    words = [f"v{k}" for k in range(2000)]
    items = [(k, [rng.choice(words) for _ in range(rng.randint(14, 120))]) for k in range(300)]
    shingles = lambda w: collections.Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
    rows, want = [], set()
    for k in range(1500):
        i, own = items[k % 300]
        own, kind = list(own), k % 3
        for _ in range(rng.randint(0, len(own) // 20)):
            if kind == 0:
                own[rng.randrange(len(own))] = rng.choice(words)
            elif kind == 1:
                own.pop(0 if rng.random() < 0.5 else -1)
            else:
                own.insert(rng.randrange(len(own)), rng.choice(words))
        text = [rng.choice(words) for _ in range(70)] + own + [rng.choice(words) for _ in range(70)]
        rows.append((k, " ".join(text)))
        b, n = shingles(items[i][1]), len(items[i][1])
        if any(sum((one & b).values()) * 100 >= sum((one | b).values()) * 80 for one in (shingles(text[a : a + n]) for a in range(50, len(text) - n + 1))):
            want.add((k, i))
    short = [(1000, "Rare one"), (1001, "rare, two words!"), (1002, "..."), (1003, "")]
    rows += [(2000, "a rare one here"), (2001, "one rare"), (2002, "so rare two words"), (2003, "rare two")]
    got = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame([(i, " ".join(w)) for i, w in items] + short, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in got.collect()}
    assert {(k, i) for k, i in got if k >= 2000} == {(2000, 1000), (2002, 1001)}
    got = {(k, i) for k, i in got if k < 2000}
    assert got <= want and len(want) > 500 and len(got) >= 0.99 * len(want)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for i, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(int(c) if j % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for j, c in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_personal_data(spark):
    rng = random.Random(2)
    pieces = ["a.b@c.de", "x@y", "p@q.r.s_t@u.vw", "@", ".", "1.2.3.4", "1.2.3.4.5", "0001.02.3.255", "256.1.1.1", "9.9.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "5", "+1 (212) 555-0100", "+1", "+44 20 7946 0958 ", "12345678901234567890123", "é", "\U0001f600", " ", "-", "_", "Dr. Anna Smith", "123-45-6789", "call 212-555-0100", "DE89 3704 0044 0532 0130 00"]
    rows = [(k, "".join(rng.choice(pieces) + rng.choice(["", " ", ", ", "\n"]) for _ in range(rng.randint(0, 14)))) for k in range(300)]
    rows += [(1000, "a" * 50_000), (1001, "1" * 50_000), (1002, "+1" + " " * 50_000 + "2"), (1003, "1 " * 20_000), (1004, "a@b." * 5000)]
    for r in pii.find_personal_data(frame(spark, rows)).collect():
        want = base_spans(dict(rows)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r.doc_id, r.spans, want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_labelers_are_weighed():
    counts = [((4, 1, 1, 1, 2), 40), ((4, 0, 0, -1, 2), 60), ((4, 1, 0, -1, 2), 5)]
    p, _ = pii.estimate(counts)
    assert p[4, 1, 1, 1] > 0.9 and p[4, 0, 0, -1] < 0.1
    weights = pii.train_classifier(counts, p)
    assert pii._accepted(counts, weights, 0.8) == [(4, 1, 1, 1, 2)] and pii.estimate([]) == ({}, {})


def test_reliabilities_are_recovered():
    """Votes drawn from known reliabilities: the estimates come near them, and the classes stay apart."""
    rng = random.Random(2)
    rates = [({-1: 0.0, 0: 0.1, 1: 0.9}, {-1: 0.0, 0: 0.7, 1: 0.3}), ({-1: 0.2, 0: 0.1, 1: 0.7}, {-1: 0.2, 0: 0.7, 1: 0.1}), ({-1: 0.4, 0: 0.0, 1: 0.6}, {-1: 0.95, 0: 0.0, 1: 0.05})]
    seen = collections.Counter()
    for _ in range(30_000):
        own = 0 if rng.random() < 0.35 else 1
        seen[(7, *(rng.choices(pii.VOTES, [r[own][v] for v in pii.VOTES])[0] for r in rates), 2)] += 1
    share, got = pii.estimate(list(seen.items()))[1][7]
    assert abs(share - 0.35) < 0.03
    assert all(abs(got[j][c][v] - rates[j][c][v]) < 0.03 for j in range(3) for c in (0, 1) for v in pii.VOTES)


def test_added_spans(spark):
    """Planted spans of the further kinds are added, look-alikes without signs of them aren't."""
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    good = [
        lambda: ("secret", hexes(40), 'token = "'),
        lambda: ("secret", "ghp_" + hexes(36), "api key: "),
        lambda: ("local_phone", f"({rng.randint(2, 9)}12) 555-{rng.randint(1000, 9999)}", "call "),
        lambda: ("iban", "DE89 3704 0044 0532 0130 00", "our bank account "),
        lambda: ("person", f"Dr. {rng.choice(pii.GIVEN_NAMES)} Smith", "a letter from "),
    ]
    bad = [lambda: ("local_phone", f"1{rng.randint(10, 99)}-1{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "size "), lambda: ("iban", f"ZZ{rng.randint(10, 99)}{rng.randint(10**15, 10**16 - 1)}", "part "), lambda: ("secret", "a" * 30 + "1", "see ")]
    rows, want = [], {}
    for k in range(400):
        kind, span, before = (good if k % 2 else bad)[rng.randrange(5 if k % 2 else 3)]()
        text = f"some words {before}"
        rows.append((k, f"{text}{span} and so on"))
        want[k] = f"{kind}:{len(text)}:{len(text) + len(span)}"
    got = {r.doc_id: r.spans for r in pii.find_personal_data(frame(spark, rows)).collect()}
    assert [k for k in range(0, 400, 2) if want[k] in got[k].split(",")] == []
    assert sum(want[k] in got[k].split(",") for k in range(1, 400, 2)) == 200


def test_quality_on_held_out_rows(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "quiet", "river", "runs", "over", "stones", "and", "mills"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["BUY!!", "cl1ck", "%%%", "|", "$$$", "N0W!!"]) + str(rng.randrange(99)) for _ in range(40))
    y = {k: int(rng.random() < 0.7) for k in range(400)}
    df = frame(spark, [(k, good() if y[k] else bad()) for k in y])
    labels = spark.createDataFrame([(k, v) for k, v in y.items()], "doc_id long, quality int")
    out = quality.score(df, quality.train(df, labels, opts=quality.Training(epochs=4))).select("doc_id", "score", quality.held_out().alias("held")).collect()
    held = [r for r in out if r.held]
    assert {r.doc_id for r in held} == {k for k in y if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([(r.score >= 0.3) == bool(y[r.doc_id]) for r in held]) > 0.95


def test_quality_features_and_scores(spark):
    """Features counted by hand and scores by a plain loop, for texts together, alone and in pieces."""
    rng = random.Random(11)
    letters = "abcé ß\U0001f600\n\t "
    texts = [None, "", " ", "a", "ab ab", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(200))]

    def features(text):
        words = re.findall(WORD, text or "")
        out = len(words) + max(len(words) - 1, 0)
        return out + sum(max(len(w) + 2 - n + 1, 0) for w in words for n in (3, 4))

    gain = np.random.default_rng(0).normal(size=1 << 16)
    model = quality.QualityModel(gain, 0.25, (3, 4))
    together = quality.scores_of(texts, model)
    for text, score in zip(texts, together, strict=True):
        found = [quality.features_of(c, o, 1 << 16, (3, 4))[0] for c, o in quality._gathered(iter([text]))]
        f = np.concatenate(found) if found else np.zeros(0, int)
        assert len(f) == features(text)
        assert score == round(1 / (1 + np.exp(-0.25 - (gain[f].mean() if len(f) else 0.0))), 9)
    one = lambda t: next(quality._gathered(iter([t])))
    assert len(set(quality.features_of(*one("x x x"), 1 << 16, (3,))[0].tolist())) == 3  # the word, its pair with itself, its n-gram
    word = np.concatenate([quality.features_of(*one(w), 1 << 30, (3, 4))[0] for w in ("ab", "ré", "ab")])
    assert set(word.tolist()) <= set(quality.features_of(*one("ab ré ab"), 1 << 30, (3, 4))[0].tolist())
    long = " ".join(rng.choice(["one", "été", "word"]) for _ in range(quality.PIECE // 3)) + "x" * (quality.PIECE + 5)
    assert "".join("".join(map(chr, p)) for p in quality.pieces_of(long)) == long


def test_held_out_labels_are_not_learned(spark):
    df = frame(spark, [(k, f"text {k}") for k in range(50)])
    flip = lambda only: spark.createDataFrame([(k, int((k % 2 == 0) != (only and zlib.crc32(str(k).encode()) % 5 == 0))) for k in range(50)], "doc_id long, quality int")
    a, b = (quality.train(df, flip(x), opts=quality.Training(epochs=1)) for x in (False, True))
    assert (a.gain == b.gain).all() and a.bias == b.bias


def test_media_round_trip(spark, tmp_path):
    rows = [(1, "x"), (2, "x"), (3, "é" * 576), (4, ""), (5, None), (6, "y" * 576)]
    folder = f"file://{tmp_path}/m"
    index = media_shards.write_media(frame(spark, rows), folder)
    got = {r.doc_id: r for r in media_shards.read_media(index, folder).collect()}
    for i, t in rows:
        payload = media_shards.payload_of((t or "").encode())
        assert len(payload) % 576 == 0 and media_shards.from_png(media_shards.to_png(payload)) == payload
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[1].digest == got[2].digest and got[1].feature == got[2].feature
    assert {(r.width, r.height) for r in media_shards.read_headers(index, folder).collect()} == {(576, 1), (576, 2)}
    import tarfile

    for f in (tmp_path / "m").glob("*.tar"):
        with tarfile.open(f) as t:
            for m in t.getmembers():
                assert hashlib.sha256(t.extractfile(m).read()).hexdigest() == m.name.removesuffix(".png")


def test_tokens_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello, world!! it's", "a<|endoftext|>b <|ENDOFTEXT|>", "ÀÉ é x̸= ≠,", "İ ſ ŉ K", "tok=\"a\", b's. 12,34;x_y… z w", "don't!!! %%% 'tis", "", "日本語。テキスト, 😀😀."]
    rows = [(k * 7 - 20, t) for k, t in enumerate(texts)]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_orc.encode_and_read_back(frame(spark, rows), path, 2).collect()}
    encode, start = Tokenizer.from_file(path).encode, 0
    for i, t in sorted(rows):
        ids = [*encode(t, add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)


def test_tokens_of_another_tokenizer(spark):
    """A file with other rules isn't encoded by words."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_orc.by_words(public_tokenizers.path("word_bpe_49k.json")) and not token_orc.by_words(path)
    rows = [(1, "Two  Words,\n and <|endoftext|> more"), (2, ""), (3, " é\U0001f600 "), (4, None)]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_orc.encode_and_read_back(frame(spark, rows), path, 2).collect()}
    for i, t in rows:
        ids = [*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_sharding(spark):
    rows = [(k, f"text {k % 50}") for k in range(4000)]
    out = sharding.shard_documents(frame(spark, rows)).collect()
    again = {r.doc_id: r.shard for r in sharding.shard_documents(frame(spark, rows[::-1])).collect()}
    assert {r.doc_id: r.shard for r in out} == again
    moved = [r for r in out if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {8} and 300 < len(moved) < 600
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and 400 < len(slots) < 600
    assert all(r.size == len(dict(rows)[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(dict(rows)[r.doc_id].encode()) for r in out)


def test_reweighted_leaf_moves_only_across_its_own_levels(spark):
    tree = sharding.balanced_tree()
    region, other = tree.children
    rack, rest = region.children
    heavier = sharding.Node(rack.name, (sharding.Node(rack.children[0].name, shard=0, leaf_weight=2.0), *rack.children[1:]))
    changed = sharding.Node(tree.name, (sharding.Node(region.name, (heavier, rest)), other))
    df = spark.range(3000).selectExpr("id AS doc_id", "'' AS text")
    a, b = ({r.doc_id: r.shard for r in sharding.shard_documents(df, t).collect()} for t in (tree, changed))
    inside = {0, 1}
    assert all(b[k] in inside or b[k] in {2, 3} and a[k] in {4, 5, 6, 7} for k in a if a[k] != b[k])


def test_schedule_stays_within_a_block():
    rng = random.Random(0)
    for _ in range(20):
        slots = mixing.slots_of({f"s{k}": rng.random() ** 3 for k in range(rng.randint(1, 30))}, 1000)
        order, done = mixing.schedule(slots), collections.Counter()
        assert collections.Counter(order) == slots
        for t, k in enumerate(order, 1):
            done[k] += 1
            assert all(abs(done[s] - t * w / 1000) < 1 for s, w in slots.items())


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(k, "x" * rng.randint(0, 300), rng.choice(["a", "a", "a", "b", None])) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, {"a": 1.0, "b": 1.0}, block_bytes=500, period=100).collect()
    assert len(out) == 600 and {r.taken for r in out if r.source is None} == {False}
    size = lambda r: len(r.text) + 1
    for s in "ab":
        own = sorted((r for r in out if r.source == s), key=lambda r: r.place)
        assert [r.place for r in own] == [sum(map(size, own[:k])) for k in range(len(own))]
        assert all(r.block == r.place // 500 and r.slot // 100 == r.block // 50 for r in own)
    shares = [sum(map(size, (r for r in out if r.taken and r.source == s))) for s in "ab"]
    assert abs(shares[0] - shares[1]) <= 2 * 800 and shares[1] > 0.9 * sum(size(r) for r in out if r.source == "b")


def test_mixture_keeps_every_document(spark):
    """A hot source, a source of one row and a row without a source, against plain Python."""
    rng = random.Random(6)
    rows = [(k, "x" * rng.randint(0, 300), rng.choice(["hot"] * 6 + ["b", "c"])) for k in range(500)] + [(500, "y", "one"), (501, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    placed = mixing.mix(df, block_bytes=500).collect()
    totals = collections.Counter()
    for _, t, s in rows:
        totals[s] += len(t) + 1
    order = mixing.schedule(mixing.slots_of(mixing.tempered(totals, 0.7), 1000))
    held, done, want = collections.defaultdict(list), collections.Counter(), []
    for r in sorted(placed, key=lambda r: r.place):
        held[r.source, r.place // 500].append(r.doc_id)
    while len(want) < len(rows):
        for s in order:
            want += held[s, done[s]]
            done[s] += 1
    assert [r.doc_id for r in mixing.mixture(df, block_bytes=500).collect()] == want
    pipeline = importlib.import_module("corpus_pipeline")
    assert sorted(r.doc_id for r in pipeline.mixed_documents(spark, df, "").collect()) == list(range(502))


def test_mixing_of_more_sources_than_a_group(spark):
    """Groups of about four sources, in levels: each block has a slot of its own, and each source
    is near its share after any slot until one runs out."""
    rows = [(k, "x" * 99, f"s{k % 40}" if k % 3 else "hot") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    weights = {f"s{k}": 1.0 for k in range(40)} | {"hot": 20.0}
    out = mixing.mix(df, weights, block_bytes=100, period=1000, group=4).collect()
    slots = sorted((r.slot, r.source, r.block) for r in out)
    assert len({x[0] for x in slots}) == len(rows) and {r.block for r in out if r.source == "hot"} == set(range(1000))
    got, done, total = [x for x in slots if x[0] < min(x[0] for x in slots) + 500], collections.Counter(), sum(weights.values())
    for n, (_, s, j) in enumerate(got, 1):
        assert j == done[s]
        done[s] += 1
        assert all(abs(done[k] - n * w / total) < 4 for k, w in weights.items())


def test_mixing_of_very_many_sources(spark):
    df = spark.range(10_500).selectExpr("id AS doc_id", "'text' AS text", "concat('www.', id, '.example') AS source")
    out = mixing.mix(df)
    assert out.where("slot IS NOT NULL").select("slot").distinct().count() == 10_500
    assert mixing.mixture(df).count() == 10_500


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."
    rows = [
        (1, "p/LICENSE", mit),
        (2, "p/a/x.py", "plain words"),
        (3, "p/a/b/y.py", "some words\nLicensed under the Apache License, Version 2.0.\nmore words"),
        (4, "p/a/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (5, "p/a/c/d/z.py", "plain words"),
        (6, "q/x.py", "we have no license to speak of here and these words are not close to any of them"),
        (7, "z.py", None),
        (8, "p", "plain"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, where string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan_licenses(df, df["where"]).collect()}
    assert got == {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "header"), 4: ("GPL-3.0", "file"), 5: ("GPL-3.0", "inherited"), 6: (None, "none"), 7: (None, "none"), 8: (None, "none")}


def test_licence_cosines_and_inheritance(spark):
    """Whole texts, with their counts, and lines against plain cosines; folders against a walk upwards."""
    rng = random.Random(14)
    pool = ["license", "mit", "permission", "granted", "software", "copyright", "words", "other", "v2.0", *(f"t{k}" for k in range(50))]
    rows = []
    for k in range(250):
        parts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 4))]
        if k % 5 == 0:
            parts.append(rng.choice([x for xs in licenses.TEMPLATES.values() for x in xs]))
        if k % 9 == 0:
            parts = [rng.choice(list(licenses.FULL.values()))]
        if bare := k % 13 == 0:
            parts = []
        folder = "/".join(["bare" if bare else "top", *(rng.choice("ab") for _ in range(rng.randint(0, 4)))])
        rows.append((k, "\n".join(parts), f"{folder}/{'LICENSE' if k % 11 == 0 else f'{k}.txt'}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    out = {r.doc_id: r for r in licenses.scan_licenses(df, df["path"]).collect()}
    terms = lambda t: re.findall(licenses.TERM, t.lower())
    held = collections.Counter(t for _, x, _ in rows for t in set(terms(x)))
    vocabulary = {t for xs in [*licenses.TEMPLATES.values(), list(licenses.FULL.values())] for x in xs for t in terms(x)}
    idf = lambda t: np.log((1 + len(rows)) / (1 + (held[t] if t in vocabulary else 0))) + 1

    def vector(text):
        w = {t: n * idf(t) for t, n in collections.Counter(terms(text)).items()}
        norm = np.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    def cosine(a, b):
        a, b = vector(a), vector(b)
        return sum(x * b.get(t, 0.0) for t, x in a.items())

    lines = [x for xs in licenses.TEMPLATES.values() for x in xs]
    for k, text, _ in rows:
        if not re.search(licenses.CUE, text):
            assert out[k].similarity == 0
            continue
        whole = max(cosine(text, x) for x in lines + list(licenses.FULL.values()))
        best = max([whole, *(cosine(line, x) for line in text.split("\n") if re.search(licenses.CUE, line) for x in lines)])
        # windows within a text may be nearer still
        assert out[k].similarity >= round(best, 6) - 2e-6 and (out[k].origin == "file" or whole < 0.7)
    files = collections.defaultdict(collections.Counter)
    for k, _, path in rows:
        if out[k].origin == "file":
            files[path.rsplit("/", 1)[0]][out[k].license] += 1
    for k, _, path in rows:
        if out[k].origin in ("inherited", "none"):
            at = path.rsplit("/", 1)[0].split("/")
            above = [("/".join(at[:n])) for n in range(len(at), -1, -1)]
            found = next((files[f] for f in above if f in files), None)
            assert out[k].license == (min(found, key=lambda x: (-found[x], x)) if found else None)
    assert {r.origin for r in out.values()} == {"file", "header", "inherited", "none"}


def test_licence_scan_of_a_long_text(spark):
    """Time grows with the length of a text, not with its square."""
    import time

    seconds = []
    for n in (20_000, 160_000):
        df = spark.createDataFrame([(1, "license " + " ".join(f"t{k}" for k in range(n)), "a/b.txt")], "doc_id long, text string, path string")
        began = time.perf_counter()
        assert licenses.scan_licenses(df, df["path"]).first().license is None
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 8 * seconds[0] + 5


def test_licenses_in_their_common_forms(spark):
    """Wrapped notices behind comment marks, a complete licence file, identifiers, notices in prose."""
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nint x;"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n" + "value = compute(left, right)\n" * 20
    mit = licenses.FULL["MIT"].replace("MIT License. ", "MIT License\n\nCopyright (c) 2019 Some Body. All rights reserved.\n\n")
    wrapped = lambda t: "\n".join(textwrap.fill(x, 76) for x in t.split("\n"))
    prose = " ".join(f"word{k}" for k in range(150))
    rows = [
        (1, "a/x.c", mpl, "MPL-2.0", "header"),
        (2, "b/x.py", gpl, "GPL-3.0", "header"),
        (3, "c/LICENSE", wrapped(mit), "MIT", "file"),
        (4, "c/d/x.py", "plain words", "MIT", "inherited"),
        (5, "e/text", wrapped(mit), "MIT", "file"),
        (6, "f/x.py", "# SPDX-License-Identifier: MIT\nx = 1", "MIT", "header"),
        (7, "g/x.py", "// SPDX-License-Identifier: Apache-2.0", "Apache-2.0", "header"),
        (8, "h/x.py", "SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0", "header"),
        (9, "i/x.py", "SPDX-License-Identifier: ISC", "ISC", "header"),
        (10, "j/x", f"{prose} Licensed under the Apache License, Version 2.0. {prose}", "Apache-2.0", "header"),
        (11, "k/x", f"{prose} the licence office has no permission to speak of licensed trades {prose}", None, "none"),
        (12, "l/x", wrapped("Copyright (c) 2001 Some Body. All rights reserved.\n" + licenses.FULL["BSD-3-Clause"]), "BSD-3-Clause", "file"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, where string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan_licenses(df, df["where"]).collect()}
    assert got == {r[0]: r[3:] for r in rows}


def test_pipeline(spark, tmp_path):
    """All five stages on a corpus of copies, passages and poor texts, against plain Python."""
    pipeline = importlib.import_module("corpus_pipeline")
    rng = random.Random(21)
    rows = [(i, t) for i, t in corpus(21, 150)]
    rows += [(1000 + k, " ".join(rng.choice(["$$$", "###", "%%%"]) + f"w{rng.randrange(400)}" for _ in range(30))) for k in range(40)]
    items = [(k, " ".join(rng.choice([t for _, t in rows[:150] if len(t.split()) > 60]).split()[5:45])) for k in range(3)]
    label = lambda i: int(i < 1000)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, label(i), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = quality.train(docs, labels)
    good = [r for r, s in zip(rows, quality.scores_of([t for _, t in rows], model), strict=True) if s >= 0.3]
    assert sum(label(i) for i, _ in good) == 150 and len(good) < 155
    found = classes(good, 5)
    first = [r for r in good if found[0][r[0]][2]]
    shingles = lambda w: collections.Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))

    def holds(text, item):
        w, other = words_of(text), words_of(item)
        b = shingles(other)
        return any(sum((one & b).values()) * 100 >= sum((one | b).values()) * 80 for a in range(-len(other), len(w)) if (one := shingles(w[max(a, 0) : a + len(other)])))

    want = {i: t for i, t in first if not any(holds(t, s) for _, s in items)}
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want) < len(first) < len(good)
    assert {r.doc_id: r.shard for r in got} == {r.doc_id: r.shard for r in sharding.shard_documents(docs).collect() if r.doc_id in want}
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_decontamination_joins_fingerprints_alone(spark):
    """No shingles in the index or in what is joined with it, whose rows are many; items of one id
    with the same words in another order, so with one fingerprint, are told apart."""
    one, two = "a1 b2 c3 d4 e5 f6 g7", "g7 f6 e5 d4 c3 b2 a1"
    items = spark.createDataFrame([(1, one), (1, two), (2, two), (None, one)], "item_id long, text string")
    assert not [f.name for f in decontaminate._index(decontaminate.items_of(items)).schema if f.dataType.typeName() == "array"]
    docs = spark.createDataFrame([(7, f"x y {two} z"), (7, f"x y {two} z"), (8, one)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.similarity, r.start) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(7, 1, 1.0, 2), (7, 2, 1.0, 2), (8, 1, 1.0, 0), (8, None, 1.0, 0)}
