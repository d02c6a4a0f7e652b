import re

from graphloom.operators import mentions
from graphloom.plans.mentions import credit_tables

SF = "/root/testdata/sf0.001"


def slug(s):
    return re.sub("[^a-z0-9]+", "-", s.lower()).strip("-")[:64]


def plain_mentions(text, ids, alias):
    """Pass after pass over one text; registry: ids, and normalised alias -> id."""
    known = lambda s: s if s in ids else alias.get(" ".join(s.lower().split()))
    found = []
    for m in re.finditer(r"[a-zA-Z][a-zA-Z0-9._-]*", text):
        if len(m[0]) > 1 and known(m[0].lower()):
            found.append((m.start(), 0, known(m[0].lower()), "word", m[0].lower()))
    for m in re.finditer(r"github\.com/([a-zA-Z0-9][a-zA-Z0-9_-]*)/([a-zA-Z0-9][a-zA-Z0-9._-]*)", text):
        s = f"{m[1]}/{m[2]}"
        found.append((m.start(1), 1, known(s) or f"entity:repo:{slug(s)}", "repo", s))
    for m in re.finditer(r"(?i)https?://([a-z0-9.-]+\.[a-z]{2,})", text):
        s = m[1].lower()
        found.append((m.start(1), 2, known(s) or f"entity:url:{slug(s)}", "url", s))
    for m in re.finditer(r"(?a:\b)[A-Z][a-zA-Z0-9]{3,39}(?a:\b)", text):
        s = m[0]
        if s not in mentions.PLAIN_WORDS and s != s.upper() and not known(s):
            found.append((m.start(), 3, f"entity:symbol:{slug(s)}", "symbol", s))
    out = {}
    for start, rank, e, kind, s in sorted(found):
        out.setdefault(e, (kind, s, start, start + len(s)))
    return out


def test_forms_and_registry(spark):
    texts = [
        (1, "Acme ships acme and ACME with RocketSled, HTTP and RocketSled2. The widget-x.js runs."), (2, None), (3, ""),
        (4, "see https://Docs.Example.com/a and http://docs.example.com plus github.com/Org/repo.name github.com/Org/repo.name"), (5, "9widget a bb lone"), (6, "Widget.js Monday Über Straße entity7 x"),
        (7, "Acme " * 5000 + "RocketSled"), (7, "Acme"),
    ]
    df = spark.createDataFrame(texts, "id long, text string")
    e = spark.createDataFrame([("corp", 1, ["Acme", "widget-x.js", "two words"]), ("other", 2, ["acme", "Widget.js"]), ("docs", 3, ["docs.example.com"]), ("entity7", 4, ["seven"]), ("w", 5, ["widget"])], "id string, seq long, aliases array<string>")
    got = {}
    for r in mentions.extract_mentions(df, e).collect():
        got.setdefault(r.id, {})[r.entity_id] = (r.kind, r.surface, r.start, r.end)
    ids, alias = {"corp", "other", "docs", "entity7", "w"}, {"acme": "corp", "widget-x.js": "corp", "two words": "corp", "widget.js": "other", "docs.example.com": "docs", "seven": "entity7", "widget": "w"}
    want = {i: plain_mentions(t, ids, alias) for i, t in texts if t}
    want[7] = {"corp": ("word", "acme", 0, 4), "entity:symbol:rocketsled": ("symbol", "RocketSled", 25000, 25010)}
    assert got == {i: m for i, m in want.items() if m}
    assert got[1]["corp"] == ("word", "acme", 0, 4) and got[4]["docs"][2] == 12 and got[6]["entity7"][0] == "word"
    assert mentions.extract_mentions(df.limit(0), e).count() == 0
    assert {r.entity_id for r in mentions.extract_mentions(df.filter("id = 1"), e.limit(0)).collect()} == {"entity:symbol:acme", "entity:symbol:rocketsled", "entity:symbol:rocketsled2"}


def test_all_documents_against_the_plain_pass(spark):
    from graphloom.plans.mentions import registry, texts

    e = registry(spark, SF).collect()
    alias = {}
    for r in sorted(e, key=lambda r: r.seq):
        for a in r.aliases:
            alias.setdefault(a, r.id)
    rows = texts(spark, SF).collect()
    want = {(r.id, k): v for r in rows for k, v in plain_mentions(r.text, {x.id for x in e}, alias).items()}
    got = {(r.id, r.entity_id): (r.kind, r.surface, r.start, r.end) for r in mentions.extract_mentions(texts(spark, SF), registry(spark, SF)).collect()}
    assert got == want and {v[0] for v in want.values()} == set(mentions.KINDS)


def plain_credits(asks, matches, edges, cap):
    """Ask after ask, peer after peer, as a single process would."""
    about = {}
    for e in edges:
        if e.relation == "mentions" and e.target:
            about.setdefault(e.source, set()).add(e.target)
    per = {}
    for m in sorted(matches, key=lambda m: (m.ask_id, m.position)):
        peers = [p for p in [m.source_peer, *(m.also_from_peers or [])] if p and p != "local"]
        for p in peers:
            if about.get(m.node_id):
                per.setdefault(m.ask_id, {}).setdefault(p, set()).update(about[m.node_id])
    sources = {}
    for m in matches:
        if m.source_peer and m.source_peer != "local":
            sources.setdefault(m.ask_id, set()).add(m.source_peer)
    state, out = {}, {}
    for a in sorted(asks, key=lambda a: (a["at"], a.ask_id)):
        if a.satisfaction < 0.4 or not re.match(r"(?i)did:[a-z0-9]+:.+", a.reviewer):
            continue
        src = sources.get(a.ask_id, set())
        for p, subjects in per.get(a.ask_id, {}).items():
            w = 1.0 if p in src else 0.4
            for s in subjects:
                score, known = a.satisfaction, state.setdefault(s, {})
                if cap and w < 1:
                    score = min([score, *([max(known[x][3] for x in src if x in known)] if any(x in known for x in src) else [])])
                total, count, last, _ = known.get(p, (0, 0, a["at"], 0))
                d = 0.5 ** ((a["at"] - last).total_seconds() / 86400 / 45)
                total, count = total * d + w * score, count * d + w
                known[p] = total, count, a["at"], (1.5 + total) / (3 + count)
                out[s, p, a.ask_id] = (w, round(score, 9))
    return out


def test_credits_equal_the_plain_loop(spark):
    tables = credit_tables(spark, SF)
    rows = [t.collect() for t in tables]
    for cap in (True, False):
        got = {(r.subject, r.peer, r.ask_id): (r.weight, round(r.score, 9)) for r in mentions.review_credits(*tables, cap=cap).collect()}
        want = plain_credits(*rows, cap)
        assert got == want and len(want) > 100
    free = plain_credits(*rows, False)
    assert any(v != free[k] for k, v in plain_credits(*rows, True).items())  # the cap binds


def test_cap_that_never_binds_and_odd_rows(spark):
    asks = spark.createDataFrame([(1, 10, "did:key:a", 0.5), (2, 20, "did:key:a", 0.4), (3, 30, "mailto:x", 0.9), (4, 40, "did:key:b", 0.39), (5, 50, None, 0.9), (6, 60, "did:key:a", None)], "ask_id long, s long, reviewer string, satisfaction double").selectExpr("ask_id", "timestamp_seconds(s) as at", "reviewer", "satisfaction")
    matches = spark.createDataFrame([(k, 0, 7, "p", ["q", "p", "local", None, ""]) for k in range(1, 7)] + [(1, 1, 8, None, None), (2, 1, 7, "local", ["r"])], "ask_id long, position long, node_id long, source_peer string, also_from_peers array<string>")
    edges = spark.createDataFrame([(7, "s", "mentions"), (7, "s", "mentions"), (7, "t", "next"), (8, "u", "mentions")], "source long, target string, relation string")
    a, b = ({tuple(r) for r in mentions.review_credits(asks, matches, edges, cap=c).collect()} for c in (True, False))
    assert {r[1:3] for r in b} == {("p", 1), ("q", 1), ("p", 2), ("q", 2), ("r", 2)}
    assert {(r[1], r[2]): r[5] for r in a} == {(r[1], r[2]): r[5] for r in b}  # 0.5 is no more than any posterior here
