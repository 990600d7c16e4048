import re

from hypothesis import given, settings, strategies as st

from tessera.llm.common import words
from tessera.llm.decontaminate import build_search, decontaminate, merge_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w, hit, found = brute_words(text), set(), set()
    for name, item in items:
        own = brute_words(item)
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == own[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(name)
    return len(w), len(hit), sorted(found)


letters = st.text(alphabet="aAbé -.\n1", max_size=60)


@settings(max_examples=200, deadline=None)
@given(letters, st.lists(letters, max_size=4))
def test_search_is_brute_force(text, items):
    w = words(text.encode())
    assert [x.decode() for x in w] == brute_words(text)
    spans, found = [], set()
    for search in build_search([i.encode() for i in items], 4):
        for start, owners in search.find(w):
            spans.append((start, start + search.m))
            found.update(owners)
    n, hit, names = brute(text, list(enumerate(items)), 4)
    assert (len(w), sum(e - s for s, e in merge_spans(spans)), sorted(found)) == (n, hit, names)


def test_blocks_of_items_and_edges(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    items = [("a", passage), ("b", "Short ITEM"), ("c", None), (None, "lonely"), ("d", ""), ("b", "short item"), ("e", "x " * 12)]
    texts = [None, "", f"before {passage} after", "a short item here", "lonely", f"{passage} " * 400, "x " * 30, "É é"]
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate([*texts, texts[2]])], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    expected = {k: brute(t, [(n or "", t2) for n, t2 in items]) for k, t in enumerate([*texts, texts[2]])}
    for block_bytes in (1 << 20, 60):  # one pass, and several
        rows = decontaminate(docs, bench, block_bytes=block_bytes).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.hit_items) for r in rows} == expected
        assert all(sum(s.end - s.start for s in r.hit_spans) == r.n_hit for r in rows)
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
