"""Plain Python versions of the language, url, toxicity and packing operators and of the pipeline's stages."""
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard as zs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, quality_rules, toxicity, url_filter
from corpusloom.session import ensure_checkpoint_dir

SPACE = r"[^\x20\x09-\x0D]+"
ODD_NAMES = ("_key", "_k", "_h", "_hash", "_bad", "_kept", "_new", "row", "k", "hash", "kept", "text_hash", "h", "w", "x", "line")


def trigrams(text):
    raw = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    raw = [32 if b < 65 else b for b in raw]
    return [
        (((a << 16) | (b << 8) | c) * 2654435761 % 2**32) >> 17
        for a, b, c in zip(raw, raw[1:], raw[2:], strict=False) if a != 32 or b != 32
    ]


def languages(rows, per_text=200, prior=20.0):
    """rows: (id, text, declared, host, domain, suffix). Gives id -> (language, probability, kept)."""
    names = [x for x, _ in sorted(Counter(r[2] for r in rows if r[2]).items(), key=lambda x: (-x[1], x[0]))]
    counts = {x: Counter() for x in names}
    for r in rows:
        if r[2]:
            counts[r[2]].update(trigrams(r[1]))
    size, m = 1 << 15, len(names) + 1
    totals = {x: sum(c.values()) + 0.5 * size for x, c in counts.items()}
    ll, best = {}, {}
    for i, text, *_ in rows:
        t = trigrams(text)
        scale = min(1.0, per_text / max(1, len(t)))
        ll[i] = [scale * sum(math.log((counts[x][b] + 0.5) / totals[x]) for b in t) for x in names] + [-scale * len(t) * math.log(size)]
        best[i] = ll[i].index(max(ll[i])) if t else None
    whole = [sum(b == j for b in best.values()) for j in range(m)]
    top = [(x + 1) / (sum(whole) + m) for x in whole]

    def group(at):
        out = defaultdict(lambda: [0] * m)
        for r in rows:
            if best[r[0]] is not None:
                out[r[at]][best[r[0]]] += 1
        return out

    groups = {at: group(at) for at in (2, 3, 4, 5)}
    found = {}
    for r in rows:
        p = top
        for at in (4, 3):  # domain, then host; a row's own verdict is taken out
            if r[at]:
                c = [x - (j == best[r[0]]) for j, x in enumerate(groups[at][r[at]])]
                p = [(x + prior * y) / (sum(c) + prior) for x, y in zip(c, p, strict=True)]
        logs = [a + math.log(b) for a, b in zip(ll[r[0]], p, strict=True)]
        for at in (2, 5):
            if r[at]:
                logs = [x + math.log((groups[at][r[at]][j] + 0.5) / (whole[j] + m)) for j, x in enumerate(logs)]
        most = max(logs)
        probability = 1 / sum(math.exp(x - most) for x in logs)
        name = [*names, "und"][logs.index(most)]
        found[r[0]] = name, round(probability, 6), best[r[0]] is not None and name != "und" and probability >= 0.5
    return found


def test_language_posteriors_equal_plain_python(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("text", language_id.page_text(F.col("html")))
    evidence = language_id.page_evidence(F.col("url"), F.col("html"))
    got = {r["doc_id"]: (r["language"], r["probability"], r["kept"]) for r in language_id.identify_language(pages, doc_id="page_id", **evidence).collect()}
    rows = []
    for r in pages.collect():
        host = re.search(r"://([^/?#]*)", r["url"])[1].lower()
        declared = re.search(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?\s*([A-Za-z]+)""", r["html"])
        rows.append((r["page_id"], r["text"], declared[1].lower() if declared else "", host, ".".join(host.split(".")[-2:]), host.split(".")[-1]))
    want = languages(rows)
    assert {i: (x[0], x[2]) for i, x in got.items()} == {i: (x[0], x[2]) for i, x in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-4 for i in want)


@pytest.mark.parametrize("classes", [1, 7, 64])
def test_more_than_32_languages(spark, monkeypatch, classes):
    monkeypatch.setattr(language_id, "CLASSES", classes)
    rng = np.random.default_rng(3)
    rows = []
    for n in range(40):
        letters = [chr(97 + x) for x in rng.permutation(26)[:6]]
        words = ["".join(rng.choice(letters, 5)) for _ in range(30)]
        rows += [(100 * n + i, " ".join(rng.choice(words, 60)), f"l{chr(97 + n // 26)}{chr(97 + n % 26)}") for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify_language(d, declared=F.col("lang")).join(d, "doc_id").where("language = lang and kept").count()
    assert got == len(rows)


def test_blocks_of_languages_do_not_change_results(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 9 == 0, "english").otherwise(F.col("lang")))
    run = lambda: sorted(language_id.identify_language(docs, declared=F.col("lang"), host=F.col("source")).collect())
    want = run()
    assert {r["language"] for r in want} <= {"en", "de", "fr", "es", "und"}  # what is no code declares nothing
    monkeypatch.setattr(language_id, "CLASSES", 2)
    assert run() == want


def plain_split(name, model, total):
    """Most probable split, by trying every piece at every place; ties to the later cut."""
    unknown = -round(1e6 * max(math.log(1e9), math.log(total)))
    best = [(0, [])]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(end):
            piece = name[start:end]
            options.append((best[start][0] + max(model.get(piece, -10**18), unknown - 2_300_000 * len(piece)), start))
        value, start = max(options)
        best.append((value, [*best[start][1], name[start:end]]))
    return best[-1][1]


@pytest.mark.parametrize("seed", range(5))
def test_segments_equal_plain_splits(seed):
    rng = np.random.default_rng(seed)
    for _ in range(200):
        counts = {"".join(rng.choice(list("abc"), int(rng.integers(2, 7)))): int(rng.integers(1, 50)) for _ in range(int(rng.integers(0, 12)))}
        total = max(1, sum(counts.values()) + int(rng.integers(0, 1000)))
        model = {w: url_filter.log_probability(n, total) for w, n in counts.items()}
        name = "".join(rng.choice(list("abcd"), int(rng.integers(0, 40))))
        assert url_filter.segment(name, model, total) == plain_split(name, model, total)


def test_very_long_names_and_words(spark):
    word = "abcdefghijklmnopqrstuvwxyz" * 3  # longer than what names meet words by
    name = (word + "free" + "bets") * 1200  # over 100,000 letters
    rows = [(1, f"http://a.org/{name}", f"free bets {word} {word[:30]}zz free bets {word}"), (2, f"http://{word}.org/", ""), (3, "http://a.org/" + "q" * 100_000, "")]
    got = {r["page_id"]: r["tokens"] for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][-3600:] == [f"p:{w}" for w in (word, "free", "bets")] * 1200 and len(got[1]) == 3602
    assert got[2] == [f"h:{word}", "h:org"] and got[3][2:] == ["p:" + "q" * 100_000]


def test_url_verdicts_equal_plain_python(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    long_name = "http://" + "freebets" * 40 + ".org/a"
    extra = spark.createDataFrame([(9001, long_name, "free bets"), (9001, long_name, "free bets"), (9002, None, None), (9003, "x", "")], "page_id long, url string, html string")
    rows = pages.select("page_id", "url", "html").unionByName(extra)
    plain = rows.collect()
    counts = Counter()
    for r in plain:
        text = re.sub(r"(?s)<(script|style)[^>]*>.*?</\1>|<[^>]*>|&\w+;", " ", (r["html"] or "").lower())
        counts.update(w for w in re.findall(r"[^\W\d_]+", text) if len(w) >= 2)
    total = sum(counts.values())
    model = {w: round(1e6 * math.log(n / total)) for w, n in counts.items()}

    def tokens(side, text):
        return [f"{side}:{w}" for name in re.findall(r"[^\W\d_]+", text.lower()) for w in plain_split(name, model, total)]

    got = url_filter.filter_urls(rows.withColumn("row", F.lit(1)).withColumn("token", F.lit("t"))).collect()
    assert len(got) == len(plain)
    seen = {v: Counter() for v in ("allow", "block")}
    ruled = Counter()
    for r in got:
        assert r["tokens"] == tokens("h", r["host"]) + tokens("p", r["path"])
        if r["rule"]:
            ruled[r["verdict"]] += 1
            seen[r["verdict"]].update(r["tokens"])
    v = len(set(seen["allow"]) | set(seen["block"]))
    size = {x: sum(c.values()) + v for x, c in seen.items()}
    for r in got:
        odds = math.log((ruled["block"] + 1) / (ruled["allow"] + 1)) + sum(
            math.log((seen["block"][t] + 1) / size["block"]) - math.log((seen["allow"][t] + 1) / size["allow"])
            for t in r["tokens"] if t in seen["block"] or t in seen["allow"])
        assert abs(r["block_odds"] - odds) < 1e-6
        assert r["rule"] or r["verdict"] == ("block" if r["block_odds"] > 0 else "allow")


def test_toxicity_scores_equal_plain_zstandard(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit_toxicity(d, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    rows = d.where("doc_id % 10 = 0").unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0)], d.schema))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(rows, model).collect()}
    plain = zs.ZstdCompressionParameters(
        window_log=17, chain_log=14, hash_log=15, search_log=6, min_match=4, target_length=16, strategy=zs.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    both = [zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(x, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=plain)
            for x in (model.dictionaries.ordinary, model.dictionaries.toxic)]
    for r in rows.where("doc_id % 50 = 0 or doc_id is null or doc_id = -1").collect():
        words = re.findall(r"\w+", (r["text"] or "").lower())
        saved = []
        for i in range(0, len(words), 3):
            window = b" " + " ".join(words[i : i + 3]).encode() + b" " + toxicity.FRAME
            a, b = (len(c.compress(window)) for c in both)
            saved.append(a - b)
        hits = sum(s >= model.threshold for s in saved)
        x = [1.0, math.log1p(hits), max([0, *saved]), 100 * hits / (100 + len(saved))]
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(p * q for p, q in zip(x, model.weights, strict=True))))))
        own = got[r["doc_id"]]
        assert abs(own["score"] - want) < 1e-9 and own["predicted"] == (own["score"] >= 0.7)
        assert own["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_other_tokenizers_get_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  World, it's 42!\n\tünï ", "", None, "a" * 5000, "two words"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = packing.pack(d, tokenizer=path, end_id=50256).toPandas()
    tokenizer = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 50256], "<u4")
        assert b"".join(rows[rows.doc_id == i].sort_values("start").ids) == ids.tobytes()


def test_open_windows_are_closed_by_cutting():
    packer = packing.LevelPacker(64, most=10)
    cut = lambda p, n: ((p[0], n), (p[0], p[1] - n))
    for i in range(100):
        packer.place((i, 40))
        if packer.n_open > packer.most:
            packer.close(cut)
        assert packer.n_open <= 11
    packer.finish(cut)
    held = Counter()
    for w in packer.done:
        total = sum(p[-1] for p in w)
        assert total == 64 or total & (total - 1) == 0
        for i, n in w:
            held[i] += n
    assert held == {i: 40 for i in range(100)}


@pytest.mark.parametrize("name", ["near", "lines", "keep", "clean"])
def test_no_column_name_clashes(spark, sf, name):
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    run = {
        "near": jaccard_join.drop_near_duplicates, "lines": lambda x: line_dedup.dedup_lines(x, least=1),
        "keep": lambda x: language_id.keep_identified(x, declared=F.col("lang")), "clean": lambda x: decontaminate.decontaminate(x, bench),
    }[name]
    odd = d.select("*", *[F.lit(c).alias(c) for c in ODD_NAMES])
    want, got = run(d).collect(), run(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert all(r[c] == c for r in rows for c in ODD_NAMES)
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in want)


def pieces(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs}


def tiled(item, doc, least):
    """Greedy string tiling by comparing all places."""
    a, b, matched = list(item), list(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] is not None and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = n, i, j
        n, i, j = best
        if n < least:
            return matched
        a[i : i + n], b[j : j + n] = [None] * n, [False] * n
        matched += n


def test_each_stage_of_the_pipeline_equals_plain_python(spark, sf):
    """Every stage over what the plain version of the one before it left; short documents, so that plain tiling ends."""
    from test_operators import classes

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    first = [r["text"] for r in bench.orderBy("item_id").take(2)]
    added = [(90001, "intro words here " + first[0], "en", "src0"), (90002, "42 17 !!", "en", "src0"), (90003, first[1], "en", "src1")]
    docs = docs.unionByName(spark.createDataFrame([(*a, len(a[1])) for a in added], docs.schema)).cache()
    stages = dict(corpus_pipeline.STAGES)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], "", "") for r in docs.collect()]
    kept = {i for i, x in languages(rows).items() if x[2]}
    now = stages["language_id"](spark, docs, sf)
    assert {r["doc_id"] for r in now.collect()} == kept and 90002 not in kept

    plain, seen, want = sorted((r["doc_id"], r["text"]) for r in now.collect()), [], {}
    for i, t in plain:
        left = []
        for line in t.split("\n"):
            s = set(re.findall(SPACE, line.lower()))
            if not s or not any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                left.append(line)
            if s:
                seen.append(s)
        if re.search(SPACE, "\n".join(left)) or not re.search(SPACE, t):
            want[i] = "\n".join(left)
    now = stages["line_dedup"](spark, now.cache(), sf).cache()
    assert {r["doc_id"]: r["text"] for r in now.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect())

    named = classes(sorted(want.items()))
    now = stages["ngram_jaccard_join"](spark, now, sf).cache()
    assert {r["doc_id"] for r in now.collect()} == {c for _, c in named.values()}

    items = [re.findall(r"\w+", r["text"].lower()) for r in bench.collect()]
    clean = set()
    for r in now.collect():
        words = re.findall(r"\w+", r["text"].lower())
        grams = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
        near = [x for x in items if any(tuple(x[j : j + 5]) in grams for j in range(len(x) - 4))]
        if not any(tiled(x, words, 5) >= 0.5 * len(x) for x in near):
            clean.add(r["doc_id"])
    before = {r["doc_id"] for r in now.collect()}
    now = stages["benchmark_decontamination"](spark, now, sf).cache()
    assert {r["doc_id"] for r in now.collect()} == clean < before

    ids = pieces([(r["doc_id"], r["text"]) for r in now.collect()])
    found = defaultdict(list)
    for r in stages["packing"](spark, now, sf).collect():
        found[r["doc_id"]].append(r)
    assert set(found) == set(ids)
    for i, own in found.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = np.array(ids[i][at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["doc_tokens"] == len(ids[i]) and r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids[i])


def test_nothing_staged_is_left(spark, sf):
    docs, pages = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "pages"))
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    staged = lambda: sorted(x for x in os.listdir(folder) if x.startswith("staged-"))
    before = staged()
    language_id.identify_language(docs, declared=F.col("lang"), host=F.col("source")).count()
    url_filter.filter_urls(pages).count()
    quality_rules.quality_verdicts(docs).count()
    with pytest.raises(Exception, match="broken"):
        quality_rules.quality_verdicts(docs.withColumn("text", F.raise_error(F.lit("broken")).cast("string"))).count()
    assert staged() == before
