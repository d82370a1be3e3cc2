"""Decontamination, licences, secrets and web pages against plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from molfold.llm import decontaminate as D
from molfold.llm import html_text as H
from molfold.llm import license_scan as L
from molfold.llm import secrets as S
from molfold.llm.license_texts import PHRASES, TEMPLATES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- decontamination ---


def plain_contamination(docs, items, width=10):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for item, question in items:
            q = words(question)
            size = min(width, len(q))
            windows = {tuple(q[i : i + size]) for i in range(max(1, len(q) - width + 1))} if q else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    if item is not None:
                        found.add(str(item))
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=repr)


def benchmark_corpus():
    rng = random.Random(2)
    pool = ["Abc", "été", "x1", "of", "THE", "İz", "q"]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(20)] + [(3, "zz yy"), (None, "q1 q2 q3"), (90, None), (91, "?!")]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(pool, k=rng.randint(0, 80)))) for i in range(60)]
    docs += [(200, "(" + (items[5][1] or "") + ")! ZZ, yy."), (201, None), (202, ""), (5, docs[5][1]), (None, "q1 q2 q3"), (203, "w " * 50000 + items[7][1])]
    return docs, items


@pytest.mark.parametrize("size", [4 << 20, 300])
def test_contamination(shared, size):
    """One automaton, and several where the windows do not fit into one."""
    docs, items = benchmark_corpus()
    df = shared.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS hits", "2 AS n_words")
    bench = shared.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS window")
    got = sorted((tuple(r) for r in D.contamination(df, bench, automaton_bytes=size).collect()), key=repr)
    assert got == plain_contamination(docs, items)


def test_spans_point_into_the_original(shared):
    text = "é—Before… The QUICK, brown fox! after"
    df = shared.createDataFrame([(1, text)], "doc_id long, text string")
    bench = shared.createDataFrame([(7, "the quick brown fox")], "item_id long, text string")
    span = D.benchmark_hits(df, bench).first().hits.spans[0]
    assert text[span.start : span.end] == "The QUICK, brown fox"
    assert D.keep_uncontaminated(df, bench).count() == 0


def test_contamination_of_empty_tables(shared):
    none = shared.createDataFrame([], "doc_id long, text string")
    items = shared.createDataFrame([], "item_id long, text string")
    docs = shared.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.contamination(none, items).collect() == []
    assert [tuple(r) for r in D.contamination(docs, items).collect()] == [(1, 2, 0, 0, sha(""), False)]


# --- licences ---


def test_license_phrases(shared):
    rng = random.Random(4)
    pool = "mit MIT license License apache general public of the gnu".split()
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 60)))) for i in range(80)] + [(100, None), (101, ""), (1, "mit license"), (None, "Apache-License")]
    df = shared.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS labels")
    want = []
    for d, text in docs:
        w = words(text)
        at = [(i, label) for phrase, label in PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in at]
        want.append((d, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    rows = L.scan_licenses(df).collect()
    assert sorted((tuple(r)[:6] for r in rows), key=repr) == sorted(want, key=repr)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert L.scan_licenses(df.where("false")).collect() == []


def test_matching_statistics():
    """Every run of the automaton is a run of some sequence, and the other way round."""
    rng = random.Random(1)
    for _ in range(60):
        sequences = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        a = L.SuffixAutomaton()
        for k, s in enumerate(sequences):
            a.add(k, s)
        a.finish()
        text = [rng.randrange(3) for _ in range(30)]
        state = length = 0
        for i, x in enumerate(text):
            while state and x not in a.next[state]:
                state = a.link[state]
                length = a.length[state]
            state = a.next[state].get(x, 0)
            length = length + 1 if state else 0
            inside = lambda n: any(s[j : j + n] == text[i + 1 - n : i + 1] for s in sequences for j in range(len(s)))  # noqa: B023, E731
            assert length == max(n for n in range(i + 2) if n == 0 or inside(n))
            for k, end in a.ends[state].items() if length else ():
                ends = [j for j in range(length - 1, len(sequences[k])) if sequences[k][j + 1 - length : j + 1] == text[i + 1 - length : i + 1]]
                assert end == ends[0]


def test_templates_are_found_whole_and_in_part():
    index = L.LicenseIndex()
    for _, label, text in TEMPLATES:
        row = index.row(("word other " + text + " the end of").encode())
        assert row["score"] == 1.0 and label in row["labels"].split(",")
    w = TEMPLATES[0][2].split()
    cut = index.row(" ".join(w[:30] + ["CHANGED"] + w[31:60]).encode())
    assert "mit" in cut["labels"] and 0.5 < cut["score"] < 1
    assert index.row(b"the of and to in is with by for from this that at be or an")["labels"] == ""


@pytest.mark.parametrize(
    ("kind", "label"),
    [("", "cc-by"), ("-ShareAlike", "cc-by-sa"), ("-NoDerivatives", "cc-by-nd"), ("-NonCommercial", "cc-by-nc"), ("-NonCommercial-ShareAlike", "cc-by-nc-sa"), ("-NonCommercial-NoDerivatives", "cc-by-nc-nd")],
)
def test_sibling_licences_are_told_apart(kind, label):
    index = L.LicenseIndex()
    short = label[3:].upper()
    for text in (
        f"This work is licensed under a Creative Commons Attribution{kind} 4.0 International License",
        f"This work is licensed under a Creative Commons Attribution{kind} 3.0 Unported License",
        f"Licensed under CC {short} 4.0.",
    ):
        assert index.row(f"before {text}, after".encode())["labels"] == label
    both = index.row(f"This work is licensed under a Creative Commons Attribution{kind} 4.0 International License. {'x ' * 40} {TEMPLATES[0][2]}".encode())
    assert both["labels"] == ",".join(sorted([label, "mit"]))


# --- secrets ---


def plain_base(text):
    text = text or ""
    kinds = (("assign", S.ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16))
    spans = [(m.start(), rank, m.end(), kind) for rank, (kind, p, g, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m.group(g)) >= least]
    return sorted(spans)


def plain_entropy(text, kind):
    """Spans of dense windows, every window counted from scratch."""
    cost, most, out = S.char_cost(S.WINDOW), S.most_cost(S.WINDOW, kind.threshold), []
    for m in re.finditer(f"{kind.pattern}{{{S.WINDOW},}}", text or ""):
        run = m.group()
        if any(re.fullmatch(p, run) for p in S.ALLOWED) or all(re.fullmatch("|".join(S.ORDINARY), part) for part in re.split(S.SEPARATORS, run)):
            continue
        dense = [i for i in range(len(run) - S.WINDOW + 1) if sum(cost[run[i : i + S.WINDOW].count(c)] for c in set(run[i : i + S.WINDOW])) <= most]
        if dense:
            out.append((m.start() + dense[0], m.start() + dense[-1] + S.WINDOW))
    return out


PATHS = [
    "com/2023/05/quick-brown-fox-jumps-over", "com/org/project-name/blob/main/src/utils2/helpers", "docs/v2/getting_started/installation-guide", "2023-05-17T12-45-33-backup_file",
    "nature12373-supplementary-information", "/usr/local/lib/python3/site-packages/HTMLParser2", "src/test/java/FooBarHandlerTest", "img_20230517T124533Z_1920x1080_final", "top-10-things-to-do-in-2024-3rd",
]


def secret_texts():
    rng = random.Random(6)
    parts = [
        "password=abcdefghijkl", "Token : 'abc.def-ghi_jkl='", "secret=short", "api_key=token=abcdefghijklmnop", "password=token: abcdefghijkl", "AKIA" + "Q7" * 8, "AKIAAKIA1",
        "deadbeef" * 3, "0123456789abcdef0", "ÀÉ\U0001f600", "\x01\x02", "Zk9xQ2mB7vLr5TtY1wNc8sHd3fGj", "x" * 40, "123e4567-e89b-12d3-a456-426614174000", "some-long-hyphenated-words-here", "2024-01-02-03-04-05-06-07",
        "PASSWD\"   =  \"aaaaaaaaaaaaaaaa", "secret==xxxxxxxxxxxx", *PATHS, "com/2023/Zk9xQ2mB7vLr5TtY1wNc8sHd3fGj/main",
    ]
    return [rng.choice(["", " ", "\n"]).join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(120)] + [None, "", "7c4f" * 700, "a1-b2_" * 3000, " ".join(["0f1e2d3c4b5a69788796"] * 1500)]


def test_secrets(shared):
    docs = [*enumerate(secret_texts()), (3, "password=abcdefghijkl"), (None, "password=abcdefghijkl")]
    df = shared.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS `all`")
    want = []
    for d, text in docs:
        base = plain_base(text)
        found = sorted(base + [(s, 3 + k, e, c.kind) for k, c in enumerate(S.CLASSES) for s, e in plain_entropy(text, c)])
        shown = lambda spans: ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)
        want.append((d, *[sum(r == k for _, r, *_ in base) for k in range(3)], sha(shown(base)), shown(found)))
    assert sorted((tuple(r) for r in S.scan_secrets(df).collect()), key=repr) == sorted(want, key=repr)
    assert S.scan_secrets(df.where("false")).collect() == []


def test_ordinary_paths_stay_and_random_keys_go(shared):
    rng = random.Random(9)
    letters = S.DIGITS + S.LETTERS + "+/_-"
    keys = ["".join(rng.choices(letters, k=n)) for n in (24, 32, 40, 64) for _ in range(250)]
    df = shared.createDataFrame([(k, t) for k, t in enumerate(PATHS + keys)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in S.scan_secrets(df).select("doc_id", "spans").collect()}
    assert not any(spans[k] for k in range(len(PATHS)))
    assert sum(bool(spans[len(PATHS) + k]) for k in range(len(keys))) >= 980


def test_secrets_run_without_python(shared):
    plan = S.scan_secrets(shared.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_redaction(shared):
    rows = [(1, "a token=abcdefabcdefabcdef12 b", 5), (2, None, None), (3, "clean", 5), (3, "é deadbeefdeadbeefdead", 1)]
    df = shared.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("spans", F.lit(1))
    got = sorted((tuple(r) for r in S.redact(df, length_col="n_chars").collect()), key=repr)
    assert got == sorted([(1, "a [secret] b", 12, 1), (2, None, None, 1), (3, "clean", 5, 1), (3, "é [secret]", 10, 1)], key=repr)
    assert S.redact(df).columns == df.columns


# --- web pages ---

ARTICLE = "<p>First   para &amp; <a href='x'>link</a> with enough of its own text.<p>Second&nbsp;para,\n long enough too &lt;b&gt;."
WANTED = "First para & link with enough of its own text.\n\nSecond para, long enough too <b>."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><nav><a>Home</a></nav><article>{ARTICLE}</article><footer>foot</footer>", WANTED),
        (f"<div class='wrap'><div id=main><h1>Head</h1>{ARTICLE}</div><div class=sidebar><p>More of this</div></div>", "Head\n\n" + WANTED),
        (f"<div class=cookie-notice>We use cookies<div>{ARTICLE}</div></div><div><p>Short</div>", "Short"),
        (f"<article>{ARTICLE}<section id='comments'><p>{'I say something at length. ' * 40}</section></article>", WANTED),
        (f"<article>{ARTICLE}<form><input><button>Go</button></form><script>x('</p>')</script><!-- <p>no</p> --></article>", WANTED),
        (f"<article><p class=ad>Buy<p>{ARTICLE[3:]}", WANTED),
        ("just text &eacute; <br>here", "just text é here"),
        ("<p>a < b and c > d", "a < b and c > d"),
        ("", ""),
        ("<html><script>only code", ""),
        ("<div><b>unclosed", "unclosed"),
    ],
)
def test_pages(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "layout with-nav", "page-with-menu", "social-article", "search-result-body", "sidebar layout"])
def test_layout_names_do_not_drop_the_page(name):
    for holder in ("article", "section"):
        page = f"<div class='{name}'><{holder}>{ARTICLE}</{holder}></div><div class=sidebar><p>More of this</div>"
        assert H.main_text(page) == WANTED


def test_marked_elements_that_hold_an_article_stay():
    assert H.main_text(f"<form id=aspnet><div class=widget><article>{ARTICLE}</article></div></form>") == WANTED
    assert H.main_text(f"<div class=cookie-body-notice>Cookies</div><article>{ARTICLE}</article>") == WANTED


def test_articles_in_parts_and_what_stands_beside_them():
    other = "A second part of the page that is just as long as the first one and has no links."
    lead = "A lead that stands in main, outside of the article, and is long enough to count."
    assert H.main_text(f"<article>{ARTICLE}</article><article><p>{other}</article>") == f"{WANTED}\n\n{other}"
    assert H.main_text(f"<main><h1>Title</h1><p>{lead}</p><article>{ARTICLE}</article></main><p>{other}") == f"Title\n\n{lead}\n\n{WANTED}"


@pytest.mark.parametrize("tag", ["p", "h2", "blockquote", "section"])
def test_dense_siblings_of_any_tag_stay(tag):
    lead = "A lead beside the body of the text, long and without any links, belongs to it. "
    page = f"<{tag}>{lead}</{tag}><div class=body>{ARTICLE * 12}</div><ul><li><a href=x>Other page</a><li><a href=y>One more</a></ul>"
    assert H.main_text(page) == "\n\n".join([lead.strip(), *[WANTED] * 12])


def _article(part):
    return f"<body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>{'Long prose of the article goes on here, and on. ' * 8}</p>{part}<p>{'More prose to end the article with words. ' * 6}</p></article><footer>Foot</footer></body>"


@pytest.mark.parametrize("tag", ['section id="search-algorithms"', 'section id="skip-lists"', 'p class="share-price"', 'div id="social-history"', 'section id="search"', 'section class="related-work"'])
def test_sections_named_like_what_surrounds_an_article_stay(tag):
    prose = "Prose in a section of the article that has a name of its own. " * 3
    assert prose.strip() in H.main_text(_article(f"<{tag}>{prose}</{tag.split()[0]}>"))


@pytest.mark.parametrize(
    "part",
    [
        "<ul><li><a href=1>Story one</a></li><li><a href=2>Story two</a></li></ul>",
        "<div><a href=1>Home</a><a href=2>Story</a><a href=3>Politics</a></div>",
        "<table><tr><td><a href=1>Story</a> <a href=2>Story</a></td></tr></table>",
        '<div class="share-buttons">Story</div>',
        '<div class="comment-list">Story</div>',
        '<div class="related-posts">Story</div>',
    ],
)
def test_link_lists_and_marked_elements_inside_an_article_go(part):
    text = H.main_text(_article(part))
    assert "Story" not in text and "Long prose" in text and "More prose" in text


def test_page_table(shared):
    rows = [(1, "u", "<p>Hello <b>there</b></p>"), (2, None, None), (2, None, None), (None, "v", "x" * 300000)]
    df = shared.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {(r.page_id, r.n_chars) for r in H.extract_text(df).collect()}
    assert got == {(1, 11), (2, 0), (None, 300000)} and H.extract_text(df).count() == 4
    assert H.extract_text(df.where("false")).collect() == []
