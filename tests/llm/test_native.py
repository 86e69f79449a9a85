import hashlib
import re

from helpers import docs_frame, frame, odd_rows
from pyspark.sql import functions as F

from runweave.llm import chat, pii, queries, urlrules, warc
from runweave.llm.common import table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


HARD = [
    "a.b+c@x-y.co.uk, a@b.c_x@d.e @no x@y é😀@a.b", "mail a@b@c.d.e.. x@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111111111",
    "+1 (988) 555-2485 +12 +123456789012345678 ++1 22 33 44 55", "x\x01y a@b.co \x02 +1 234 567 890\x01", "é" * 50 + " a@b.co", "1" * 3000, "a." * 3000 + "@" + "b." * 3000 + "c", "9 " * 500,
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, bad DE00370400440532013000", "call 555-123-4567 or 555-123-4567", "my ssn 078-05-1120 is", "",
]


def test_base_spans_match_plain_patterns(spark, sf):
    odd = odd_rows() + [(100 + i, t, "a") for i, t in enumerate(HARD)]
    for df in (docs_frame(spark, odd), table(spark, sf, "documents")):
        for r in pii.find_pii(df).select("text", "base", "spans").collect():
            assert [(s.kind, s.start, s.end) for s in r.base] == brute(r.text), r.text[:200]
            assert r.spans[: len(r.base)] == r.base


def test_added_spans(spark):
    got = {r.text: [(s.kind, r.text[s.start : s.end]) for s in r.spans[len(r.base) :]] for r in pii.find_pii(docs_frame(spark, [(i, t, "a") for i, t in enumerate(HARD)])).collect()}
    assert got[HARD[10]] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert got[HARD[11]] == [("local_phone", "555-123-4567")] * 2
    assert got[HARD[12]] == [("ssn", "078-05-1120")]


def test_redaction_and_query(spark, sf):
    df = docs_frame(spark, [(1, "x a@b.co y +1 (988) 555-2485.", "a"), (2, None, "a"), (3, "clean", "a")])
    assert [r.text for r in pii.redact(pii.find_pii(df)).orderBy("doc_id").collect()] == ["x <EMAIL> y <PHONE>.", None, "clean"]
    text = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in queries.op10_pii(spark, sf).collect():
        want = brute(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in PLAIN]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_personal_data_keeps_columns_of_any_name(spark):
    names = ["t", "b", "m_email", "s_card"]
    df = docs_frame(spark, [(1, "x a@b.co", "a"), (2, None, "a")]).withColumns({n: F.lit("q") for n in [*names, "base"]})
    got = pii.find_pii(df).orderBy("doc_id").collect()
    assert [len(r.base) for r in got] == [1, 0] and all(r[n] == "q" for r in got for n in names)


def split(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def judge(url, rules):
    host, path = split(url)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def test_urls_match_brute_force(spark):
    rules = [*queries.URL_RULES, ("b.org", "", "block"), ("b.org", "/a", "allow"), ("b.org", "/a/b", "block"), ("b.org", "/a/b/", "allow"), ("", "/z", "block"), ("net", "/es/", "block")]
    urls = [None, "", "no scheme", "http://", "://x.com/", "http://COM/", "http://www.Example.com/en/x?y", "http://example.com", "http://a.example.com/en/", "https://x.net/es/1", "http://b.org", "http://b.org/a", "http://b.org/a/bc", "http://c.b.org/a/b/c#d", "http://ab.org/a", "http://q/z", "http://.com/x", "http://com./x", "http://x.com:80/en/", "a://b://c.net/fr/", "http://é.net/fr/" + "x" * 5000] * 2
    pages = spark.createDataFrame([(i, u, "r", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, g int")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    for parts in ("4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urlrules.judge_urls(pages, r).collect()}
        assert len(got) == len(urls)
        for i, u in enumerate(urls):
            assert got[i] == judge(u, rules), u
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert urlrules.judge_urls(pages.limit(0), r).count() == 0
    assert urlrules.judge_urls(pages, r.limit(0)).where("rule is null").count() == len(urls)


def record(i, kind, url, ts, etag=None, modified=None, digest=None, headers=None, status=200):
    return (i, kind, url, ts, status if kind == "response" else 304, etag, modified, digest, headers)


def test_revisits(spark):
    rows = [
        record(1, "response", "HTTP://A.com:80/x#f", 10, '"1"', None, "d1", {"date": "10", "etag": '"1"', "content-type": "t"}),
        record(2, "response", "http://a.com/x", 9000, '"2"', "m", "d2", {"date": "9000"}),
        record(3, "response", "http://a.com/x", 9001, '"3"', None, "d3", None, 500),
        record(4, "revisit", "http://a.com/x", 20, '"1"', None, None, {"date": "20", "content-length": "0"}),
        record(5, "revisit", "http://a.com/x", 9000, '"2"', None, None, None),
        record(6, "revisit", "http://a.com/x", 99999, '"1"'), record(7, "revisit", "http://a.com/x", 99999, None, "m"), record(8, "revisit", "http://a.com/x", 5, '"1"'),
        record(9, "revisit", None, 5, '"1"'), record(10, "revisit", "http://a.com/x", None, '"1"'), record(11, "revisit", "http://b.com", 50), record(12, "revisit", "http://a.com/x", 99999),
    ]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, status int, etag string, last_modified string, digest string, headers map<string,string>")
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert {k: (r.outcome, r.resolved_id) for k, r in got.items()} == {
        4: ("resolved", 1), 5: ("resolved", 2), 6: ("mismatch", None), 7: ("resolved", 2), 8: ("missing", None), 9: ("missing", None), 10: ("missing", None), 11: ("missing", None), 12: ("mismatch", None)}
    assert got[4].headers == {"date": "20", "etag": '"1"', "content-type": "t"} and got[4].digest == "d1"
    again = df.unionByName(df).withColumns({"latest": F.lit(1), "was": F.lit(2), "n": F.lit(3)})
    assert sorted((r.record_id, r.outcome, r.resolved_id or 0) for r in warc.resolve_revisits(again).collect()) == sorted((k, r.outcome, r.resolved_id or 0) for k, r in got.items() for _ in range(2))
    bare = spark.createDataFrame([record(None, "response", "http://c.d/", 1, None, "m", "d9"), record(None, "revisit", "http://c.d/", 1, None, "m")], df.schema)
    assert [(r.outcome, r.digest, r.headers) for r in warc.resolve_revisits(bare).collect()] == [("resolved", "d9", {})]
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_preferences(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "yes"), (0, 2, "user", "é"), (0, 3, "assistant", "b"), (1, 0, "user", "q"), (1, 1, "assistant", "yes"), (1, 2, "user", "no"), (1, 3, "assistant", None), (2, 0, None, None), (4, 5, "user", "x"), (4, 5, "user", "x"), (5, 1, "user", "x"), (None, 1, "user", "lost")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, c int")
    got = {r.pair_id: r for r in chat.preference_records(chat.neighbour_pairs(df), df).collect()}
    assert sorted(got) == [0, 1, 2]
    r = got[0]
    assert r.n_prompt == 2 and r.prompt == "<|user|>\nq<|end|>\n<|assistant|>\nyes<|end|>\n" and r.usable
    assert [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["b<|end|>\n"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_mask] == ["<|end|>\n"]
    assert (got[1].n_prompt, got[1].rejected, got[1].usable) == (0, "", False)
    assert got[2].n_prompt == 1 and got[2].rejected == ""
    assert chat.preference_records(chat.neighbour_pairs(df.limit(0)), df).count() == 0


def test_turns_render_whole(spark, sf):
    pdf = frame(queries.op8_preference_format(spark, sf))
    text = frame(table(spark, sf, "conversations"))
    assert sum(pdf.chosen.str.count(r"<\|end\|>")) + sum(pdf.rejected.str.count(r"<\|end\|>")) + 2 * pdf.n_prompt.sum() == len(text)
