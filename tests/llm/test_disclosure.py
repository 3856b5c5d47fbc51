import math
import random
import re
from collections import Counter

import pytest

from quire.llm.disclosure import KINDS, personal_data, sanitised
from tests.llm.helpers import sha

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 // 10 + int(c) * 2 % 10 for i, c in enumerate(reversed(d))) % 10 == 0


def plain(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [("email", *m.span(), m[0].lower()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span(), m[0]) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span(), digits(m[0])) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span(), digits(m[0])) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


POOL = {"email": lambda v: v.split("@")[-1], "ip": lambda v: ".".join(v.split(".")[:2]), "card": lambda v: v[:6], "phone": lambda v: v[:4]}
TERM = re.compile(r"[^\W_]+")


def bound(x, m):
    """Wilson's lower bound, one standard error."""
    r = x / m
    return (r + 1 / (2 * m) - math.sqrt(r * (1 - r) / m + 1 / (4 * m * m))) / (1 + 1 / m)


def disclosed(texts, general=0.75, remove=0.85):
    """{text number: term spans} by plain counting over whole texts."""
    runs = [[(m.start(), m.end(), m[0].lower()) for m in TERM.finditer(t)] for t in texts]
    held = [{x[2] for x in r} for r in runs]
    n_t = Counter(w for h in held for w in h)
    base = [plain(t) for t in texts]
    found, n = {}, len(texts)
    for i, b in enumerate(base):
        for kind, _, _, value in b:
            found.setdefault((kind, value), set()).add(i)
            found.setdefault(("pool", kind, POOL[kind](value)), set()).add(i)
    out = {}
    for docs in found.values():
        e = len(docs)
        if not 1 < e < n:
            continue
        p = (e - 1) / (n - 1)
        for w, k in Counter(w for i in docs for w in held[i] if len(w) >= 3).items():
            if k < 2:
                continue
            low = bound(k - 1, n_t[w] - 1)
            kind = next((v for v, share in (("remove", remove), ("general", general)) if math.log2(low) >= (1 - share) * math.log2(p) - 1e-9), None)
            if kind is None:
                continue
            for i in docs:
                own = [(a, b) for _, a, b, _ in base[i]]
                for a, b, x in runs[i]:
                    if x == w and not any(s <= a and b <= z for s, z in own):
                        old = out.setdefault(i, {}).get((a, b))
                        out[i][a, b] = "remove" if "remove" in (old, kind) else kind
    return out


def generalised(word):
    return "[NUMBER]" if re.fullmatch("[0-9]+", word) else "[CODE]" if re.search("[0-9]", word) else "[NAME]" if word[0] != word[0].lower() else "[WORD]"


def corpus():
    rng = random.Random(8)
    bits = ["a.b@c.de", "x@y", "@", "+1 (555) 010-9999", "+44 20 7946 0958", "192.168.0.1", "300.1.1.1", "1.2.3", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "5500000000000004", "12345678901234567890", "q_@-.com.", "é@x.com", "\U0001F600", "..@a.b.", "a@b.c-d@e.f", "00010.001.1.255", "+1", "+12345678901234567", "word", "name", " ", "-", "\n", "9 9--9"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", ",", ". "]) for _ in range(rng.randrange(14))) for _ in range(250)]
    filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(8))
    texts += [f"{filler()} Zebulon Quist, reach zq@quist.org or by phone {filler()}" for _ in range(5)]
    texts += [f"{filler()} phone quist {filler()}" for _ in range(2)] + [filler() for _ in range(30)]
    return texts + ["", "a" * 30000, "1" * 30000, "a@" * 3000, "+1" * 2000, "1.1" * 3000, "9 " * 3000, "x@y.z " * 400]


def test_spans(spark):
    texts = corpus()
    rows = [(i, t, "k", [1]) for i, t in enumerate(texts)] + [(9999, None, "k", None), (None, "z@z.zz", "k", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, found array<int>").repartition(4)
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    assert len(got) == len(rows)
    more = disclosed(texts + ["", "z@z.zz"])
    seen = set()
    for i, t in enumerate(texts):
        base = sorted((KINDS.index(k), a, b) for k, a, b, _ in plain(t))
        line = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in range(4)], t[:200]
        assert r.base_sha256 == sha(line.encode())
        extra = sorted((KINDS.index(k), a, b) for (a, b), k in more.get(i, {}).items())
        seen |= {t[a:b] for _, a, b in extra}
        assert r.spans == ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base + extra)
    assert {"Zebulon", "phone"} <= seen
    assert got[9999].spans == "" and got[None].n_email == 1


def test_sanitised(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)] + [(-1, None, None)], "doc_id long, text string, n_chars int")
    spans = {r.doc_id: r.spans for r in personal_data(docs).collect()}
    out = sanitised(docs)
    assert out.dtypes == docs.dtypes
    for r in out.collect():
        if r.doc_id < 0:
            assert r.text is None
            continue
        want, end = "", 0
        t = texts[r.doc_id]
        got = sorted((int(a), int(b), KINDS.index(k)) for k, a, b in (x.split(":") for x in spans[r.doc_id].split(",") if x))
        regions = []
        for a, b, k in got:
            if regions and a < regions[-1][1]:
                regions[-1] = (regions[-1][0], max(b, regions[-1][1]), min(k, regions[-1][2]))
            else:
                regions.append((a, b, k))
        for a, b, k in regions:
            want += t[end:a] + ("" if KINDS[k] == "remove" else generalised(t[a:b]) if KINDS[k] == "general" else f"[{KINDS[k].upper()}]")
            end = b
        assert r.text == want + t[end:] and r.n_chars == len(r.text)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert personal_data(docs).count() == 0 and sanitised(docs).count() == 0


def test_whole_documents(spark):
    rng = random.Random(9)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    texts = corpus() + [f"Wilhelmina \U0001F600 Öztürk {filler(60)} office {filler(60)} WILHELMINA {filler(60)} mail wo@firm.example" for _ in range(4)]
    texts += [f"office {filler(30)}", texts[-1].replace("Wilhelmina", "")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    more, seen = disclosed(texts), set()
    for r in personal_data(docs).collect():
        t = texts[r.doc_id]
        base = sorted((KINDS.index(k), a, b) for k, a, b, _ in plain(t))
        extra = sorted((KINDS.index(k), a, b) for (a, b), k in more.get(r.doc_id, {}).items())
        seen |= {t[a:b] for _, a, b in extra}
        assert r.spans == ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base + extra)
    assert {"Wilhelmina", "WILHELMINA", "Öztürk", "office", "Zebulon"} <= seen
    for r in sanitised(docs).collect():
        if "wo@firm.example" in texts[r.doc_id]:
            assert "wilhelmina" not in r.text.lower() and "Öztürk" not in r.text and "[EMAIL]" in r.text


def test_query_reads_whole_documents(spark, tmp_path):
    from quire.llm.queries import op5_disclosure

    rng = random.Random(10)
    filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    texts = [f"Wilhelmina {filler()} mail wo@firm.example" for _ in range(4)] + [filler() for _ in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.spans for r in op5_disclosure(spark, str(tmp_path)).collect()}
    assert all("remove:0:10" in got[i] for i in range(4)) and not any(got[i] for i in range(4, 34))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_given_tables(spark, folder):
    """Spans of the method stand on the given tables, and are those of plain counting."""
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    more = disclosed([texts[i] for i in ids])
    got = {r.doc_id: r.spans for r in personal_data(docs).collect()}
    kinds = Counter()
    for at, i in enumerate(ids):
        mine = [x.split(":") for x in got[i].split(",") if x]
        kinds.update(k for k, _, _ in mine)
        assert {(int(a), int(b)): k for k, a, b in mine if k in ("general", "remove")} == more.get(at, {})
    if folder == "sf0.01":
        assert kinds["general"] > 0 and kinds["remove"] > 0
