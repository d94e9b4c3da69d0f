from __future__ import annotations

import random
import re
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from waybill.llm import filter_audit
from waybill.llm.text_trie import RadixTrie, routed, shared_length

SCHEMA = "doc_id long, source string, text string, mask int, part string"


def plain_failures(rows):
    """(part, failed letters) of each row."""
    out = []
    for key, source, text, *_ in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        failed = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        failed += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        twin = key is not None and any(k is not None and k < key and (t or "") == text for k, _, t, *_ in rows)
        out.append((key, source or "", failed + "E" * twin))
    return out


def plain_audit(rows, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    bad = {k for k, _, t in labels if t == 1 and k is not None}
    out = {}
    rows = plain_failures(rows)
    for part in {p for _, p, _ in rows}:
        own = [(k, f) for k, p, f in rows if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(k, f) for k, f in left if x in f]
                left = [(k, f) for k, f in left if x not in f]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == x for _, f in own),
                    sum(k in good for k, _ in gone), sum(k in bad for k, _ in gone),
                ]
    for (part, order, step), row in out.items():
        row.append(sum(r[1] for (p, o, s), r in out.items() if p == part and o[s - 1] == order[step - 1]))
    return out


def found(frame, rows, labels, route_bytes):
    docs = frame([(*r[:3], 9, "clash") for r in rows], SCHEMA)
    marks = frame(labels, "doc_id long, quality int, toxic int")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = filter_audit.audit(docs, marks, route_bytes).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got}


def test_all_orders_agree_with_a_plain_loop(frame):
    rng = random.Random(5)
    words = ["tree", "Stone", "LAMP", "river", "été", "a#b", "x", "naïve", "日本"]
    texts = [None, "", " \n\t", "tree " * 250, " ".join(f"w{i}" for i in range(300)), "A" * 3000, "long " * 60_000]
    texts += [" ".join(rng.choices(words, k=rng.choice([3, 150, 230]))) for _ in range(40)]
    texts += [" ".join(f"v{rng.randrange(400)}" for _ in range(260)) for _ in range(8)]
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(texts)) for i in rng.sample(range(1000), 150)]
    rows += [(None, "a", "tree " * 250), (None, "a", "tree " * 250), rows[0], rows[0], (rows[3][0], "c", rows[3][2])]
    labels = [(k, rng.randrange(2), rng.randrange(2)) for k, *_ in rows if k is not None and k % 2] + [(None, 1, 1), (rows[0][0], 1, 0)]
    want = plain_audit(rows, labels)
    for route_bytes in (1 << 20, 600):
        assert found(frame, rows, labels, route_bytes) == want


def test_empty_tables(frame):
    assert found(frame, [], [], 100) == {}
    assert len(found(frame, [(1, None, None)], [], 100)) == 600


def test_small_tries_give_the_same_copies(frame, monkeypatch):
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", 300)
    rows = [(i, "s", f"shared beginning {'x' * (i % 7)}") for i in range(200)]
    got = filter_audit.failures(frame([(*r, 0, "") for r in rows], SCHEMA), 64).collect()
    assert sum(r.n for r in got if not r["mask"] & filter_audit.DUPLICATE) == 7
    assert {r.doc_id for r in got if not r["mask"] & filter_audit.DUPLICATE} == set(range(7))


def test_routes_are_prefixes_and_part_texts(frame):
    texts = [b"license text " + bytes([97 + i % 26]) * (i % 40) for i in range(300)] + [b"same" * 50] * 100 + [b"", b"l"]
    out = routed(frame([(t,) for t in texts], "text binary"), 2000).collect()
    assert sorted(bytes(r.text) for r in out) == sorted(texts)
    sizes = {}
    for r in out:
        assert bytes(r.text).startswith(bytes(r.route))
        sizes.setdefault(bytes(r.route), []).append(bytes(r.text))
    assert all(sum(map(len, v)) <= 2000 or len(set(v)) == 1 for v in sizes.values())
    assert len({bytes(r.text): bytes(r.route) for r in out}) == len({(bytes(r.text), bytes(r.route)) for r in out})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=12).map(str.encode), max_size=40))
def test_trie_ends_one_text_at_one_node(texts):
    trie = RadixTrie()
    for text in texts:
        node = trie.insert(text)
        node.payload = (node.payload or []) + [text]
    groups = list(trie.terminals())
    assert all(len(set(g)) == 1 for g in groups)
    assert sorted(x for g in groups for x in g) == sorted(texts)


def test_deep_trie_and_shared_length():
    trie = RadixTrie()
    for n in range(3000):
        trie.insert(b"a" * n).payload = n
    assert sorted(trie.terminals()) == list(range(3000))
    a = b"x" * 500 + b"y" * 500
    for n in (0, 1, 31, 32, 33, 499, 500, 900):
        assert shared_length(a, 0, a[:n] + b"?" * 100, 0, min(1000, n + 100)) == n
