"""Language ID by held-out accuracy, line-frequency rules against brute force, the pipeline."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from data import DOCS, frame, odd_rows, prose
from eventmine.llm import language, line_quality

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    got = language.predict(docs.withColumn("held_out", language.held_out()), model, ["doc_id", "held_out", "lang"]).toPandas()
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all() and set(got.lang_pred) <= {*model, "und"}
    assert got.rejected.mean() < 0.02


def test_learning_takes_no_held_out_row(spark):
    rows = [(k, prose(k, 30), "en", "s", 0) for k in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    held = {r.doc_id for r in docs.where(language.held_out()).collect()}
    assert 0 < len(held) < 20
    text = language.learn(docs, per_lang=1000, excerpt=10_000)["en"].decode()
    assert {k for k, t, *_ in rows if language.plain(t.encode()).decode() in text} == set(range(40)) - held
    few = language.learn(docs, per_lang=2, excerpt=10)["en"]
    assert len(few) <= 2 * 10 + 1


def test_language_of_odd_rows(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    model = {"en": language.plain(prose(1, 400).encode()), "fr": language.plain(("é" * 30 + prose(77, 300)).encode())}
    got = language.predict(docs, model, ["doc_id", "text", "_id"]).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    for r in got:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        assert letters or (r.score == 0 and r.rejected)
    assert all(r.lang_pred == "en" for r in got if r.doc_id in (1, 2))
    kept = language.only_known(docs, model)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if not r.rejected)
    assert language.predict(docs, {}, ["doc_id"]).where("NOT rejected").count() == 0
    empty = spark.createDataFrame([], DOCS)
    assert language.learn(empty) == {} and language.predict(empty, model, ["doc_id"]).count() == 0


def test_long_texts_are_read_whole(spark):
    model = {"a": language.plain(prose(1, 2000).encode()), "b": language.plain(b"zq wx yv uj " * 50 + prose(9, 50).upper().encode())}
    mostly_a = prose(5, 200) + " " + prose(6, 20_000)
    text = "zq wx yv uj " * 5 + mostly_a
    langs, by = list(model), language.compressors(model.values())
    assert language.predict_one(text.encode(), langs, by, 0)[0] == "a"
    assert language.predict_one(("zq wx yv uj " * 30_000).encode()[:40_000], langs, by, 0)[0] == "b"


def brute_features(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for j in range(k, k + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.strip(" \t\n\x0b\f\r")).lower()


def brute_quality(rows, max_share, min_docs):
    texts = defaultdict(set)
    seen = defaultdict(set)
    for _, text, _, host, _ in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if WORD.search(line):
                seen[host, normal(line)].add(text)
    hot = {k for k, v in seen.items() if len(v) >= min_docs and len(v) > max(min_docs, max_share * len(texts[k[0]]))}
    out = Counter()
    for i, text, _, host, _ in rows:
        f = brute_features(text)
        left = f[0] - sum(len(WORD.findall(x)) for x in (text or "").split("\n") if (host, normal(x)) in hot)
        out[(i, *f, left, not f[-1] and left >= 20 and left >= 0.5 * f[0])] += 1
    return out


def boilerplate_rows():
    foot = "  Copyright   the\tSITE all rights reserved and more words here to make it long enough "
    rows = [(k, f"{prose(k, 15 + k % 40)}\n{foot}\n{prose(k + 900, 12)}\n\n{foot.lower()}", "en", "hot" if k % 3 else None, 0) for k in range(90)]
    rows += [(200 + k, prose(7, 50), "en", "hot", 0) for k in range(40)]  # copies count once
    rows += [(300 + k, " ".join(prose(k, 9).split() * 3) + "\n" + prose(k, 30 * (k % 3)), "en", "c", 0) for k in range(12)]
    rows += [(400, "a b c d e f g h " * 3 + prose(3, 60) + " # ** $%&|<>", "en", "c", 0), (401, "ha " * 50, "en", "c", 0)]
    return rows


@pytest.mark.parametrize("rows", [odd_rows(), boilerplate_rows()])
def test_line_frequency_rules(spark, rows):
    got = line_quality.quality(frame(spark, rows).repartition(3), max_share=0.1, min_docs=5).drop("removed_lines").collect()
    assert Counter(map(tuple, got)) == brute_quality(rows, 0.1, 5)


def test_boilerplate_lines_go_and_clean_documents_stay(spark):
    rows = boilerplate_rows()
    kept = line_quality.filtered(frame(spark, rows), max_share=0.1, min_docs=5)
    assert kept.columns == frame(spark, rows).columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    want = {k[0] for k in brute_quality(rows, 0.1, 5) if k[-1]}
    assert set(texts) == want and all(200 + k in texts for k in range(40))
    assert all("opyright" not in t for t in texts.values())
    assert line_quality.quality(spark.createDataFrame([], DOCS)).count() == 0


def test_line_rules_are_native(spark):
    from eventmine.llm import queries

    plan = queries.op10_line_frequency(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P
    from eventmine.llm import text_links

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in P.STAGES:
        stage(spark, tables[-1], "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    assert all(t.columns == columns for t in tables[:-1])
    start, known, single, clean, mixed, packed = tables
    assert known.count() >= 0.98 * start.count()
    assert text_links.links(single).where("NOT kept").isEmpty()
    assert single.count() < known.count() and clean.count() <= single.count()
    windows = Counter()
    for r in clean.select("doc_id", "text").collect():
        b = r.text.encode()
        windows.update({b[k:k + 300] for k in range(len(b) - 299)})
    assert not [w for w, n in windows.items() if n > 1]
    sizes = dict(packed.groupBy("doc_id").sum("length").collect())
    assert set(sizes) == {r.doc_id for r in mixed.select("doc_id").distinct().collect()}
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).collect()[0][0] <= 4096


def test_sql_agrees_where_there_is_sql(spark):
    from eventmine.llm import queries

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        cur = con.execute(sql)
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(got.columns)
        show = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert Counter(map(show, cur.fetchall())) == Counter(map(show, got.select(columns).collect())), name


def test_predictions_equal_plain_compression(spark):
    """The smallest compressed size over all dictionaries, by the library alone."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(120)
    model = language.learn(docs)
    got = {r.doc_id: r for r in language.predict(docs, model, ["doc_id", "text"]).collect()}
    for r in got.values():
        text = re.sub(rb"[^a-z\x80-\xff]+", b" ", r.text.lower().encode() if r.text.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in r.text.encode())).strip()
        size = {}
        for lang, content in model.items():
            how = zstandard.ZstdCompressionParameters(**language.SEARCH)
            c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
            size[lang] = sum(len(c.compress(text[k:k + language.BLOCK])) for k in range(0, len(text), language.BLOCK))
        if any(map(str.isalpha, r.text)):
            order = sorted(size.values())
            assert size[r.lang_pred] == order[0] and r.score == pytest.approx(order[1] / (order[0] + order[1]))
            assert r.rejected == (1 - order[0] / order[1] < 0.005)


def test_language_of_bytes_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text UNION ALL SELECT 2L, cast(unhex('FF') AS string)")
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, {"a": b"ab ab ab", "b": b"zz yy"}, ["doc_id"]).collect()}
    assert got[1] in ("a", "b") and got[2] == "und"


def test_only_the_commonest_languages_reach_the_driver(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('some text ', id) AS text", "concat('l', if(id < 1000, 0, id)) AS lang")
    assert len(language.learn(docs, max_langs=5)) == 5 and "l0" in language.learn(docs, max_langs=1)


def test_filtered_rows_that_share_an_id_stay_two(spark):
    rows = [(1, prose(1, 60), "en", "a", 1), (1, prose(2, 60), "en", "a", 1), (None, prose(3, 60), "en", "a", 1), (None, prose(3, 60), "en", "a", 1), (2, "short", "en", "a", 1)]
    got = line_quality.filtered(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(map(tuple, got.collect())) == Counter(rows[:4])


def test_line_rules_are_native_before_the_rows_are_written(spark, monkeypatch):
    plans = []
    orig = line_quality.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return orig(df)

    monkeypatch.setattr(line_quality, "cut_lineage", seen)
    line_quality.quality(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert len(plans) >= 2 and not any(x in p for p in plans for x in ("Python", "Pandas", "Arrow"))
