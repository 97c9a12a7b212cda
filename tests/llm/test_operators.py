"""Every operator against its plain version, on awkward rows, an empty table and driver documents."""

import hashlib
import math
from collections import Counter, defaultdict

import llm_brute as brute
import pytest
from pyspark.sql import functions as F

from trailmill.llm import bpe, decontaminate, line_dedup, lm_score, mixing, page_text, quality, repeats, resampling, sharding, shingle_join, token_counts, vector_codes
from trailmill.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.awkward_rows(), brute.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="module")
def real_pairs(real):
    return [(r["doc_id"], r["text"]) for r in real.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(brute.BENCHMARK, "item_id string, text string")


def rows(df, *names):
    return brute.in_order(tuple(r) for r in df.select(*names).collect())


def same(df, names, expected):
    assert rows(df, *names) == brute.in_order(expected)


# 1 mixing


def check_mix(rows):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    goal = brute.mix_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], goal[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["n_copies"] in (math.floor(rate), math.floor(rate) + 1) and r["n_copies"] <= 2
        taken[r["source"]] += r["n_copies"] * r["size"]
    return goal, taken, sizes


def test_mix_targets_and_reruns(docs, pairs):
    out = mixing.mix(mixing.sized_documents(docs))
    found = out.collect()
    assert [(r["doc_id"], r["size"]) for r in sorted(found, key=repr)] and len(found) == len(pairs)
    assert Counter(r["size"] for r in found) == Counter(len(brute.SPACED.findall(t or "")) for _, t in pairs)
    check_mix(found)
    assert rows(out, "doc_id", "n_copies") == rows(mixing.mix(mixing.sized_documents(docs.repartition(5))), "doc_id", "n_copies")


def test_mix_comes_near_its_targets(spark):
    goal, taken, sizes = check_mix(QUERIES["op1_mixing"](spark, "/root/testdata/sf0.01").collect())
    for s in sizes:
        assert abs(taken[s] - goal[s]) < 0.15 * goal[s] + 2000


def test_mixed_documents_keep_columns(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = {(r["doc_id"], r["size"], r["source"]): r["n_copies"] for r in mixing.mix(mixing.sized_documents(docs)).collect()}
    assert set(copies.values()) <= {0, 1, 2}
    given, got = docs.groupBy("doc_id").count().collect(), {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for r in given:
        assert got.get(r["doc_id"], 0) <= 2 * r["count"]


# 2 repeats

REPEATS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats(docs, pairs):
    same(repeats.without_repeats(docs), REPEATS, brute.repeats(pairs))


def test_repeats_of_driver_documents(real, real_pairs):
    same(repeats.without_repeats(real), REPEATS, brute.repeats(real_pairs))


def test_repeats_with_a_gram_of_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MOST", 3)
    core = brute.sentence(40, 50)
    texts = [(i, brute.sentence(100 + i // 2, 12) + " " + core[: 150 + 20 * (i % 5)] + " " + brute.sentence(200 + i // 3, 30)) for i in range(24)]
    same(repeats.without_repeats(spark.createDataFrame(texts, "doc_id long, text string")), REPEATS, brute.repeats(texts))


def brute_groups(entries, length):
    """Maximal repeats by trying every stretch of every entry."""
    found = set()
    for right, left in entries:
        for r in range(1, len(right) + 1):
            for n in range(max(0, length - r), len(left) + 1):
                group = [i for i, (x, y) in enumerate(entries) if x[:r] == right[:r] and y[:n] == left[:n]]
                longer = [{entries[i][0][r : r + 1] for i in group}, {entries[i][1][n : n + 1] for i in group}]
                if len(group) > 1 and all(len(x) > 1 or x == {b""} for x in longer):
                    found.add((tuple(group), n, r))
    return found


def test_maximal_repeats_are_grouped():
    for seed in range(30):
        letters = brute.sentence(seed, 200).replace(" ", "").replace("w", "")
        entries = sorted((letters[k : k + 5].translate(str.maketrans("0123456789", "abababaaab")).encode(), letters[k + 5 : k + 8].translate(str.maketrans("0123456789", "yyzzyyzzyz")).encode()) for k in range(0, 64, 8))
        groups = {(tuple(sorted(g)), left, right) for g, left, right in repeats.maximal_repeats([e[0] for e in entries], [e[1] for e in entries], 3)}
        assert groups == brute_groups(entries, 3) and groups
        # What the query takes of them: the farthest that the groups of an entry reach.
        reach = [(0, 0)] * len(entries)
        for group, left, right in groups:
            for i in group:
                reach[i] = (max(reach[i][0], left), max(reach[i][1], right))
        assert repeats.reaches([e[0] for e in entries], [e[1] for e in entries], 3) == reach


# 3 language model


def check_scores(df, given):
    found = brute.in_order(tuple(r) for r in df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect())
    expected = brute.in_order(brute.base_scores(given))
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    for f, e in zip(found, expected, strict=True):
        assert math.isclose(f[5], e[5], rel_tol=1e-9, abs_tol=1e-6)


def test_scores(docs, pairs):
    out = lm_score.scores(docs)
    check_scores(out, pairs)
    assert all(r["score"] < 0 for r in out.collect())


def test_scores_beat_single_tokens_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lm_score.scores(docs).cache()
    check_scores(out, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    held = out.filter("held_out").agg(F.sum("score").alias("m"), F.sum("base_score").alias("b")).first()
    assert held["m"] > held["b"]


def test_model_adds_up_to_one(spark):
    docs = spark.createDataFrame([(i, brute.sentence(i, 50)) for i in range(20)], "doc_id long, text string")
    counts = lm_score.token_counts(docs)
    known, _ = lm_score.vocabulary(counts)
    inside = (known.count + 0.5) / known.mass[known.cls]
    for c in range(lm_score.RARE):
        if (known.cls == c).any():
            assert math.isclose(inside[known.cls == c].sum(), 1, rel_tol=1e-9)


# 4 shingle join

JOIN = ("doc_id", "n_shingles", "component_id")


def test_jaccard_join(docs, pairs):
    same(shingle_join.joined(docs), JOIN, brute.jaccard_join(pairs))


@pytest.mark.parametrize("most", [shingle_join.MOST, 2_000])
def test_jaccard_join_of_driver_documents(spark, most):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    same(shingle_join.joined(docs, most), JOIN, brute.jaccard_join(given))


def test_jaccard_join_at_the_threshold(spark):
    words = ["t%d" % i for i in range(400)]
    texts = [(0, " ".join(words[:104]))]
    for k in range(1, 90):  # ends change one by one: similarity falls through 0.75
        texts.append((k, " ".join(words[: 104 - k // 3] + ["e%d_%d" % (k, j) for j in range(k // 3 + k % 3)])))
    for k in range(90, 130):  # and short ones
        texts.append((k, " ".join(words[200 : 200 + 4 + k % 9] + ["s%d" % (k // 9)])))
    given = spark.createDataFrame(texts, "doc_id long, text string")
    same(shingle_join.joined(given), JOIN, brute.jaccard_join(texts))


def test_one_of_each(docs, pairs):
    kept = shingle_join.one_of_each(docs)
    assert kept.columns == docs.columns
    expected, groups = [], set()
    sets = [brute.shingles(t) for _, t in pairs]
    roots = brute.components(sets)
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][0] is None, pairs[k][0] or 0))
    for k in order:
        if not sets[k]:
            expected.append(pairs[k])
        elif roots[k] not in groups:
            groups.add(roots[k])
            expected.append(pairs[k])
    same(kept, ("doc_id", "text"), set(expected))


def test_one_of_each_of_rows_that_differ_elsewhere(spark):
    text = brute.sentence(70, 30)
    given = [(1, text, "web", 5), (1, text, "books", 7), (1, text, "books", 6), (None, "", "a", 1), (None, "", "b", 1)]
    kept = shingle_join.one_of_each(spark.createDataFrame(given, "doc_id long, text string, source string, n long"))
    assert kept.columns == ["doc_id", "text", "source", "n"]
    same(kept, ("doc_id", "text", "source", "n"), [(1, text, "books", 6), *given[3:]])


# 5 tokens


def test_token_counts(docs, pairs, real, real_pairs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for df, given in ((docs, pairs), (real, real_pairs)):
        n = [len(e.ids) for e in library.encode_batch([t or "" for _, t in given], add_special_tokens=False)]
        expected = [(i, len((t or "").encode()), k, k > 512) for (i, t), k in zip(given, n, strict=True)]
        same(token_counts.count_tokens(df, path, public_tokenizers.PATTERN), ("doc_id", "n_bytes", "n_tokens", "over_limit"), expected)


# 6 pages

PAGE = """<!doctype html><html><head><title>T</title><style>p {{x}}</style></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a>One</a></li></ul></nav>
<div class="content-{n}"><h1>Head {n}</h1><p>First   paragraph&nbsp;of &amp; page {n}, long enough to be the text.</p>
<div class="ad-box">Buy now</div><p>Second<br>line <b>bo</b>ld &#x263A;.</p><script>var x = "</p>";</script></div>
<aside class="sidebar">More</aside><section id="comments"><p>A reader's comment</p></section><footer>Copyright</footer></body></html>"""


def test_pages(spark):
    pages = [(n, f"https://a.example/{n}", PAGE.format(n=n)) for n in range(5)] + [(90, None, None), (91, "x", ""), (92, "http://b.example", "plain text only"), (93, "http://b.example/", "<p>un<p>closed")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("path", F.lit("p"))
    found = {r["page_id"]: r["text"] for r in page_text.extract(df).collect()}
    for n in range(5):
        assert found[n] == f"Head {n}\nFirst paragraph of & page {n}, long enough to be the text.\nSecond line bold ☺."
    assert found[90] == found[91] == ""
    assert found[92] == "plain text only" and found[93] == "un\nclosed"


def test_pages_keep_text_beside_and_inside_named_containers(spark):
    lead, body, more = "The lead of it. " * 5, "The body goes on and on. " * 10, "Another section. " * 3
    side = '<div class="sidebar">Elsewhere</div>'
    rare = "Only this rare page has all of its text here. " * 8
    pages = [
        (1, "https://lead.example/1", f'<body><div class="lead">{lead}</div><div class="body">{body}</div><div class="rest">{more}</div>{side}</body>'),
        (2, "https://bar.example/1", f'<body><div class="content has-sidebar"><p>{body}</p>{side}</div></body>'),
        (3, "https://post.example/1", f'<body><article class="post no-comments share"><p>{body}</p></article></body>'),
        (4, "https://form.example/1", f'<body><form id="aspnet"><div><p>{body}</p></div><form class="search">Find</form></form></body>'),
        *[(k, f"https://rare.example/{k}", f'<body><div class="main-text"><p>{body}</p></div></body>') for k in range(5, 9)],
        (9, "https://rare.example/9", f'<body><div class="main-text">Go on:</div><div class="other"><p>{rare}</p></div></body>'),
    ]
    found = {r["page_id"]: " ".join(r["text"].split()) for r in page_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found[1] == f"{lead}{body}{more}".strip()
    assert found[2] == found[3] == found[5] == body.strip()
    assert found[4].startswith(body.strip())
    assert found[9] == f"Go on: {rare}".strip()


TEMPLATES = {
    "article": '<body><header>{junk}</header><nav>{junk}</nav><article><h1>{head}</h1>{text}</article><footer>{junk}</footer></body>',
    "comments outweigh": '<body><div class="post"><h1>{head}</h1>{text}</div><div class="comments">{long}</div></body>',
    "comments inside": '<body><article><h1>{head}</h1>{text}<section id="comments">{long}</section></article></body>',
    "comment threads": '<body><main><h1>{head}</h1>{text}</main><ol class="comment-list"><li class="comment">{long}</li></ol><div id="disqus_thread">{long}</div></body>',
    "hyphenated names": '<body><article><h1>{head}</h1><div class="ad-free-note share-price">{text}</div></article><div class="ad-slot">{junk}</div></body>',
    "state names": '<body><div class="content has-sidebar comments-open"><h1>{head}</h1>{text}<div class="sidebar">{junk}</div></div></body>',
    "related": '<body><main><h1>{head}</h1>{text}<div class="related">{long}</div><div class="outbrain">{junk}</div></main></body>',
    "wrapper": '<body><form id="aspnet"><div class="share"><h1>{head}</h1>{text}</div></form><div class="cookie-notice">{junk}</div></body>',
    "table layout": '<body><table><tr><td class="menu">{junk}</td><td><h1>{head}</h1>{text}</td></tr></table><div class="site-footer">{junk}</div></body>',
    "feedback": '<body><div id="page"><div class="entry"><h1>{head}</h1>{text}</div><div class="feedback">{junk}</div><div class="discussion">{junk}</div></div></body>',
}


def test_gold_texts_of_templates(spark):
    pages, gold = [], {}
    for t, (_, template) in enumerate(TEMPLATES.items()):
        for n in range(3):
            k = 10 * t + n
            paragraphs = [f"Paragraph {j} of page {k} says {brute.sentence(100 * k + j, 12)}." for j in range(3)]
            junk, long = f"<p>junk{k} stays out</p>", f"<p>{' '.join(['junk'] * 200)}</p>"
            page = template.format(head=f"Head {k}", text="".join(f"<p>{x}</p>" for x in paragraphs), junk=junk, long=long)
            pages.append((k, f"https://t{t}.example/{n}", page))
            gold[k] = "\n".join([f"Head {k}", *paragraphs])
    pages += [(500 + k, u, p) for k, u, p in pages[:3]]  # repeated pages
    huge = "\n".join(f"Line {j} {brute.sentence(j % 50, 30)}" for j in range(30_000))
    pages.append((900, "https://huge.example/", f"<body><nav>menu</nav><div class='content'>{''.join(f'<p>{x}</p>' for x in huge.split(chr(10)))}</div></body>"))
    found = {r["page_id"]: r["text"] for r in page_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    for k, text in gold.items():
        wanted, got = Counter(text.split()), Counter(found[k].split())
        common = sum((wanted & got).values())
        assert common == sum(wanted.values()) and common == sum(got.values()), (list(TEMPLATES)[k // 10], found[k])
    assert all(found[500 + k] == found[k] for k in range(3)) and found[900] == huge


def test_ties_of_paths_go_to_more_text_then_to_the_smaller_path(spark):
    pages = [(1, "https://a.example/1", "<body><div class='b'><p>Long enough words of the one page here</p></div></body>"), (2, "https://a.example/2", "<body><div class='a'><p>Long enough words of the one page here</p></div></body>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    (path,) = [r["path"] for r in page_text.winning_paths(df).collect()]
    assert path == "html/body/div.a"
    assert {r["text"] for r in page_text.extract(df).collect()} == {"Long enough words of the one page here"}


def test_pages_of_the_driver(spark):
    out = QUERIES["op6_page_text"](spark, SMALL).collect()
    assert len(out) == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    for r in out:
        assert r["n_chars"] == len(r["text"]) and "<script" not in r["text"]
        assert all(b == " ".join(b.split()) and b for b in r["text"].split("\n")) or not r["text"]


# 7 shards


def test_shards(docs, pairs):
    found = sharding.sharded_documents(docs).collect()
    assert len(found) == len(pairs)
    total = sum(r["size"] for r in found)
    by = defaultdict(list)
    for r in found:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        by[r["shard"]].append(r["slot"])
    largest = max(r["size"] for r in found)
    for s, slots in by.items():
        assert 0 <= s < 8 and sorted(slots) == list(range(len(slots)))
        assert abs(sum(r["size"] for r in found if r["shard"] == s) - total / 8) <= largest


def test_shards_of_driver_documents(spark):
    import zlib

    out = QUERIES["op7_sharding"](spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(out) == len(texts)
    sizes = Counter()
    for r in out:
        assert r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode())
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in out)


# 8 lines


def test_lines_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given = [(r["doc_id"], i, line) for r in docs.select("doc_id", "text").collect() for i, line in enumerate((r["text"] or "").split("\n")) if line.strip(" \t\n\r\f\v")]
    sets = [brute.line_shingles(line) for _, _, line in given]
    roots = brute.components(sets)
    first, kept = {}, defaultdict(set)
    for (i, place, _), r in sorted(zip(given, roots, strict=True), key=lambda x: (x[0][0], x[0][1])):
        if first.setdefault(r, (i, place)) == (i, place):
            kept[i].add(place)
    found = {r["doc_id"]: {int(x) for x in r["kept_places"].split(",") if x} for r in QUERIES["op8_line_dedup"](spark, SMALL).collect()}
    wanted = {(i, p) for i, s in kept.items() for p in s}
    got = {(i, p) for i, s in found.items() for p in s}
    assert wanted <= got  # what is removed has an exact reason
    removable = len(given) - len(wanted)
    assert len(got - wanted) <= 0.02 * max(50, removable)


def test_lines_on_awkward_rows(docs):
    out = line_dedup.without_fuzzy_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    assert texts[1] is None and texts[2] == "" and texts[5] == "  \t\n "
    assert texts[17].count("same line here now") == 1 and texts[7] == ""


def kept_by_brute(texts):
    """{(doc_id, place)} of the first line of each component of full shingle sets."""
    given = [(i, p, line) for i, text in texts for p, line in enumerate(text.split("\n"))]
    first = {}
    for (i, p, _), r in zip(given, brute.components([brute.line_shingles(line) for _, _, line in given]), strict=True):
        first[r] = min((i, p), first.get(r, (i, p)))
    return set(first.values())


def kept_by_spark(spark, texts):
    out = line_dedup.kept_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    return {(r["doc_id"], p) for r in out for p in r["kept"]}


def test_lines_without_spaces_and_with_long_words(spark):
    urls = [f"https://example.org/{hashlib.md5(b'%d' % k).hexdigest()}" for k in range(12)]
    han = ["".join(chr(0x4E00 + (k * 7919 + j * 104729) % 5000) for j in range(60)) for k in range(6)]
    near = [x[:2] + "々" + x[3:] for x in han] + ["龘" + urls[0][1:]]
    tails = ["始" + x for x in han]
    lines = [*urls, *han, *near, *tails, "ab", "abcdefgh", "abcdefghi", "𝒳𝒴𝒵" * 5 + "a", "𝒳𝒴𝒵" * 5 + "b"]
    texts = [(k, line) for k, line in enumerate(lines)]
    assert kept_by_spark(spark, texts) == kept_by_brute(texts)


def test_lines_that_repeat_themselves(spark):
    """Equal shingle sets, one written twice and one thirty times."""
    texts = [(2 * k + j, (brute.sentence(k + 900, 8) + " ") * n) for k in range(40) for j, n in enumerate((2, 30))]
    sets = [brute.line_shingles(t) for _, t in texts]
    assert all(100 * len(a & b) >= 75 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    assert kept_by_spark(spark, texts) == {(2 * k, 0) for k in range(40)}


def test_recall_of_pairs_near_the_threshold(spark):
    """Pairs of a similarity from 0.75 to 0.80, plain ones and ones that repeat themselves; each a group of its own."""
    pairs, seed = [], 5000
    while len(pairs) < 400:
        seed += 1
        base = brute.sentence(seed, 30 + seed % 40)
        other = base[: int(len(base) * (0.76 + seed % 11 / 100))] + brute.sentence(seed + 100_000, 5 + seed % 3)
        if seed % 2:
            base, other = " ".join([base] * 6), " ".join([other] * 5)
        a, b = brute.line_shingles(base), brute.line_shingles(other)
        if 75 * len(a | b) <= 100 * len(a & b) <= 80 * len(a | b):
            pairs.append((base, other))
    texts = [(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)]
    kept = {i for i, _ in kept_by_spark(spark, texts)}
    assert sum(2 * k + 1 not in kept for k in range(len(pairs))) >= 0.97 * len(pairs)


@pytest.mark.parametrize("many", [0, line_dedup.MANY])
def test_a_hot_band_of_several_clusters(spark, monkeypatch, many):
    """All lines share one band, of which the hub is in one cluster at most."""
    monkeypatch.setattr(line_dedup, "MANY", many)
    monkeypatch.setattr(line_dedup, "bands", lambda low: F.array(F.lit(1).cast("long")))
    texts = [(c * 10 + k, f"template of a page {brute.sentence(c + 50, 30)} number {k}") for c in range(9) for k in range(5)]
    assert kept_by_spark(spark, texts) == kept_by_brute(texts) == {(c * 10, 0) for c in range(9)}


@pytest.mark.parametrize("many", [0, line_dedup.MANY])
def test_a_hot_band_of_lines_below_the_threshold(spark, monkeypatch, many):
    """Lines of a similarity of about 0.6 to each other, and a few above: verified pairs grow with the lines, not with their square."""
    import random

    rows, written, rng = [], line_dedup.written, random.Random(8)

    def counted(df, label):
        table = written(df, label)
        if label == "line-candidates":
            rows.append(table.count())
        return table

    monkeypatch.setattr(line_dedup, "MANY", many)
    monkeypatch.setattr(line_dedup, "bands", lambda low: F.array(F.lit(1).cast("long")))
    monkeypatch.setattr(line_dedup, "written", counted)
    base, texts = brute.sentence(77, 60).split(), []
    for k in range(120):
        words = list(base)
        for at in rng.sample(range(4, 56), 4):
            words[at] = f"w{k}x{at}yzuvw"
        texts.append((2 * k, " ".join(words)))
        if k % 20 == 0:
            texts.append((2 * k + 1, " ".join([*words, "end"])))
    assert kept_by_spark(spark, texts) == kept_by_brute(texts)
    assert sum(rows) <= 4 * len(texts)


# 9 benchmark

BENCH = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def digest(df):
    return df.withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256))


def test_contamination(docs, pairs, bench):
    same(digest(decontaminate.contamination(docs, bench)), BENCH, brute.contamination(pairs, brute.BENCHMARK))


def test_contamination_without_benchmark(docs, pairs, bench):
    same(digest(decontaminate.contamination(docs, bench.limit(0))), BENCH, brute.contamination(pairs, []))


def test_clean_keeps_the_others(docs, pairs, bench):
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns
    bad = brute.contamination(pairs, brute.BENCHMARK)
    same(out, ("doc_id", "text"), [p for p, b in zip(pairs, bad, strict=True) if not b[5]])


# 10 quality


def test_quality_counts(docs, pairs):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = quality.judged(quality.counted(docs))
    same(out, names, brute.quality_counts(pairs))
    assert out.filter("base_failed AND kept").isEmpty()
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == out.filter("kept").count()


# 11 byte pairs


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


HARD_TEXTS = (
    "", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|endo", "  \n\t  a", "ab" * 5000, "é" * 700, "日本語" * 300, "\x00\x01\ufffd", "🙂" * 400,
    "a" * 3000, " " * 3000, "1" * 999, "it's we'LL 'S", "".join(chr(97 + (k * k) % 10) for k in range(20_000)), "e\u0301 \u200b\u2028x",
)


def test_bpe_like_the_library(spark, vocabulary, docs, pairs, real, real_pairs):
    import struct

    from tokenizers import Tokenizer

    path, pattern = vocabulary
    library = Tokenizer.from_file(path)
    texts = spark.createDataFrame(list(enumerate(HARD_TEXTS)), "doc_id long, text string").repartition(2)
    for df, given in ((docs, pairs), (real, real_pairs), (texts, list(enumerate(HARD_TEXTS)))):
        out = bpe.decoded(bpe.encoded(df.select("doc_id", "text"), path, pattern), path, pattern)
        expected = []
        for (i, t), e in zip(given, library.encode_batch([t or "" for _, t in given], add_special_tokens=False), strict=True):
            ids = None if t is None else struct.pack(f"<{len(e.ids)}I", *e.ids)
            expected.append((i, t, ids, None if t is None else library.decode(e.ids, skip_special_tokens=False)))
        assert brute.in_order((r["doc_id"], r["text"], None if r["ids"] is None else bytes(r["ids"]), r["decoded"]) for r in out.collect()) == brute.in_order(expected)


def test_bpe_query(spark, vocabulary, real_pairs):
    import struct

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary[0])
    expected = []
    for i, t in real_pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    same(QUERIES["op11_bpe"](spark, SMALL), ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), expected)


def test_bpe_decodes_any_ids_like_the_library(vocabulary):
    import random
    import struct

    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(vocabulary[0]), bpe.Vocabulary(*vocabulary), random.Random(3)
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(6)]
        assert own.decode(struct.pack("<6I", *ids)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_scans_and_heaps_merge_alike(vocabulary, monkeypatch):
    own = bpe.Vocabulary(*vocabulary)
    for text in HARD_TEXTS:
        for piece in own.pieces.findall(text):
            word = piece.encode()[:600]
            parts = [own.first[b] for b in word]
            assert own._scanned(list(parts)) == own._heaped(list(parts))
    monkeypatch.setattr(bpe, "REMEMBERED", 3)  # a worker that forgets
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    assert [bpe.Vocabulary(*vocabulary).encode(t) for t in HARD_TEXTS] == [own.encode(t) for t in HARD_TEXTS]


# 12 vector codes

VECTORS = "vec_id long, embedding array<double>, label int, vector int, now string, was int, error string"


def vector_rows(n=60, width=2, scale=1.0):
    rows = []
    for k in range(n):
        v = [((k * 7919 + j * 104_729) % 1000 / 500 - 1) * scale for j in range(8 * width)]
        rows.append((k if k % 9 else k // 2, v, None if k % 7 == 0 else 1 if k % 3 else k % 4))
    rows += [(None, [0.25] * (8 * width), 1), (3, [0.5] * (8 * width), None), (70, None, 1), (71, [], 1), (72, [0.1] * 9, 1), (73, [0.1] * 24, 2)]
    rows += [(74, [float("nan")] + [0.0] * (8 * width - 1), 1), (75, [float("-inf")] + [0.0] * (8 * width - 1), 1), (76, [None] + [0.0] * (8 * width - 1), 1)]
    return rows + rows[5:9]  # repeated rows


def check_codes(spark, rows):
    df = spark.createDataFrame([(*r, 1, "n", 2, "e") for r in rows], VECTORS).repartition(3)
    coded, books = vector_codes.compressed(df)
    want, text = brute.vector_codes(rows)
    code = F.array_join(F.transform("now", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    same(coded.select("vec_id", "label", code.alias("code"), "error"), ("vec_id", "label", "code", "error"), want)
    assert books.sha256 == hashlib.sha256(text.encode()).hexdigest()
    per_label = Counter()
    for _, label, _, error in want:
        per_label[label] += error
    assert {r["label"]: r["label_error"] for r in vector_codes.with_label_errors(coded).collect()} == per_label
    return coded, books


def test_vector_codes(spark):
    coded, books = check_codes(spark, vector_rows())
    far = F.aggregate(F.zip_with("vector", "approximation", lambda a, b: F.pow(a - b * 4096, F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    for r in vector_codes.restored(coded, books).select("error", far.alias("far")).collect():
        assert math.isclose(r["error"], r["far"], rel_tol=1e-9, abs_tol=1e-6)


def test_vector_codes_of_few_equal_and_large_vectors(spark):
    check_codes(spark, vector_rows(n=5))
    check_codes(spark, [(k, [0.5] * 8, 1) for k in range(40)])  # ties everywhere
    check_codes(spark, vector_rows(n=40, scale=3e4))  # beyond exact doubles


def test_only_changed_parts_are_sent(spark):
    df = spark.createDataFrame([(*r, 1, "n", 2, "e") for r in vector_rows()], VECTORS).repartition(2)
    whole = vector_codes.whole_vectors(df)
    books, length = vector_codes.first_books(whole, 8, 16)
    table = whole.filter(F.size("vector") == length).withColumn("now", F.lit(None).cast("array<int>"))
    once = vector_codes.assigned(table, books)
    twice = vector_codes.assigned(once, books)
    assert vector_codes.changes(once, books).count() > 0 and vector_codes.changes(twice, books).count() == 0


# 13 resampling

RESAMPLED = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("least", [20, 1])
def test_resampling(docs, pairs, bench, least):
    same(resampling.resampled(docs, bench, least_words=least), RESAMPLED, brute.resampled(pairs, brute.BENCHMARK, least=least))
    same(resampling.resampled(docs, bench.limit(0), least_words=least), RESAMPLED, brute.resampled(pairs, [], least=least))


def test_resampling_with_ties_null_ids_and_a_long_text(spark, bench):
    texts = [(k // 3, brute.sentence(1, 30)) for k in range(60)] + [(None, brute.sentence(2, 40)), (None, brute.sentence(3, 41)), (7, "Ünder ÄÖ x " * 20_000), (8, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    same(resampling.resampled(df, bench, share=60), RESAMPLED, brute.resampled(texts, brute.BENCHMARK, share=60))


def test_drawn_documents_are_those_with_a_rank(docs, pairs, bench):
    out = resampling.drawn_documents(docs, bench, share=40)
    assert out.columns == docs.columns
    ranked = [p for p, r in zip(pairs, brute.resampled(pairs, brute.BENCHMARK, share=40), strict=True) if r[4] is not None]
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == set(ranked)


# all


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
