import re
from collections import Counter

import duckdb
import pyarrow as pa

from tablemill.llm import quality_rules, url_filter


def metrics(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_metrics_of_odd_rows(documents, odd_rows):
    rows = [*odd_rows, (20, "a b c a b c a"), (21, "x\nx\n\nx \ny"), (22, "# * $ % & | < >"), (23, "one\x0btwo\x0cthree")]
    got = quality_rules.apply_rules(documents(rows)).collect()
    want = Counter((i, *metrics(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality_rules.apply_rules(documents([])).count() == 0


def test_verdict_is_independent_of_the_order(documents, monkeypatch):
    good = " ".join(f"plain{chr(97 + i % 26)}{chr(97 + i // 26)} words stand" for i in range(60))
    rows = [(1, good), (2, good.upper()), (3, good.replace(" ", " ## ")), (4, good + " 123456789" * 40), (5, "\n".join(f"line {i} of {i * 7} some" for i in range(40)))]
    seen = set()
    for order in (list(quality_rules.RULES), list(quality_rules.RULES)[::-1]):
        monkeypatch.setattr(quality_rules, "cascade_order", lambda *a, order=order: order)
        seen.add(tuple(sorted((r.doc_id, r.kept) for r in quality_rules.apply_rules(documents(rows)).collect())))
    assert len(seen) == 1 and dict(seen.pop())[1] is True


def test_duckdb_agrees(spark, documents):
    rows = [(i, " ".join(f"w{(i * j) % 40}x" for j in range(i * 3))) for i in range(1, 40)]
    docs = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    con = duckdb.connect()
    con.register("documents", docs)
    want = sorted(con.sql(quality_rules.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in quality_rules.apply_rules(documents(rows)).collect()) == want


def judge(url):
    url = url or ""
    host, path = "", ""
    if "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, action in url_filter.HOST_RULES:
        at, start = rule.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = (rule, action)
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?q#f", "https://a.b.example.com/en/", "http://example.com/EN/", "http://notexample.com/en/1",
    "x://y://net/es/", "http://net/es/1", "http://a.net/fr/", "http://a.net/frx", "http://spam-farm.example.org/en/1", "http://www.casino-win.example.org", "http://É.net/es/é", "http://a.com:80/", "http://user@www.example.com/en/", "http://x.org/net/es/", "http://a.net?x=/es/", "http://a.net/es/", "http://a.net/es/",
]


def test_urls_against_a_plain_loop(spark):
    rows = [(i, u, None, "h", "p") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, best = judge(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[0]), url
        spam = best is None and "spam-farm" in host
        assert got[i].verdict == (best[1] if best else "block" if spam else "allow"), url
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_rules_are_filed_under_literal_tokens():
    assert url_filter.literal_tokens("www.example.com/en/") == ["com", "en", "example", "www"]
    assert url_filter.literal_tokens("spam-farm.*/") == ["farm", "spam"]
    assert url_filter.literal_tokens("ab*cd/ef") == []


def test_quality_plan_has_no_python(documents):
    plan = quality_rules.apply_rules(documents([(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_a_slow_rule_goes_last_and_later_rules_count_what_is_left(documents):
    from pyspark.sql import functions as F

    rows = [(i, " ".join(f"w{(i * 7 + j) % 1000}" for j in range(200))) for i in range(400)]
    slow = F.aggregate(F.sequence(F.lit(1), F.lit(3000)), F.lit(0).cast("long"), lambda a, x: a + F.xxhash64(x + F.col("n_words")) % 2) > -10_000
    rules = {
        "slow": lambda: slow & (F.col("doc_id") % 4 < 3),
        "quick": lambda: F.col("doc_id") % 4 < 2,
        "same": lambda: F.col("doc_id") % 4 == 1,
        "rest": lambda: F.col("doc_id") % 4 == 3,
    }
    sample = quality_rules.base_metrics(documents(rows), "text")
    order = quality_rules.cascade_order(sample, rules)
    # `same` rejects nothing that `quick` leaves, so it comes after `rest` and even after `slow`.
    assert order[0] == "quick" and order.index("rest") < order.index("slow") < order.index("same")
    assert quality_rules.cascade_order(sample.limit(0), rules) == list(rules)


def test_thousands_of_filters_against_a_loop(spark):
    import random

    rng = random.Random(3)
    names = [f"n{i}" for i in range(60)]
    lines = ["! comment", "", "|ads.|", "^track^", "*"[:0] + "/x_*_y", "@@||n1.n2^"]
    lines += [f"||{rng.choice(names)}.{rng.choice(names)}{rng.choice(['^', '/', '*z', ''])}{rng.choice(names)}" for _ in range(3000)]
    lines += [f"{rng.choice(['', '@@'])}/{rng.choice(names)}-{rng.choice(names)}{rng.choice(['^', '*', '|', ''])}" for _ in range(1000)]
    urls = [f"http://{'.'.join(rng.sample(names, rng.randint(2, 4)))}/{rng.choice(names)}-{rng.choice(names)}{rng.choice(['', 'q', '/z', '?q'])}" for _ in range(300)]
    urls += ["http://ads.", "http://ads.x", "http://a.b/track/", "http://a.b/track", "http://a.b/tracks", "http://a.b/x_1_y", "http://n1.n2/z", "http://zn1.n2/z"]

    def fits(line, target):
        rule = line.removeprefix("@@")
        body = rule.strip("|")
        tail = body + ("" if rule.endswith("|") and len(rule) > 1 else "*")
        start = [0] if rule.startswith("|") and not rule.startswith("||") else range(len(target) + 1)
        if rule.startswith("||"):
            host_end = target.find("/") if "/" in target else len(target)
            start = [0, *(i + 1 for i in range(host_end) if target[i] == ".")]

        def match(p, at):
            if not p:
                return at == len(target)
            if p[0] == "*":
                return any(match(p[1:], k) for k in range(at, len(target) + 1))
            if p[0] == "^":
                sep = at < len(target) and not (target[at].isascii() and (target[at].isalnum() or target[at] in "_.%-"))
                return sep and match(p[1:], at + 1) or at == len(target) and match(p[1:], at)
            return at < len(target) and target[at] == p[0] and match(p[1:], at + 1)

        return any(match(tail, s) for s in start)

    rules = [x for x in lines if x and not x.startswith("!")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, host_rules=[], patterns=[], filters=lines).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1].split("?")[0]
        hits = [r for r in rules if fits(r, rest)]
        want = next((r for r in hits if r.startswith("@@")), hits[0] if hits else None)
        assert got[i].pattern == want and got[i].verdict == ("block" if want and not want.startswith("@@") else "allow"), url
