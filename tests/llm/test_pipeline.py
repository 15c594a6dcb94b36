from __future__ import annotations

import random
import re
from collections import defaultdict

import corpus_pipeline

from tests.llm.test_simhash import brute_components, brute_print

WORDS = {"en": "the of and to in that is was for with this river boat small house tree walked under over their bright".split(), "de": "der die und den von mit über nicht eine für sich haus baum fluss klein ging unter ihre hell boot als".split()}


def corpus():
    random.seed(11)
    draw = lambda lang, n: [random.choice(WORDS[lang]) + random.choice(["", "", "a", "en", "s", "er", "ing"]) for _ in range(n)]
    passage = " ".join(draw("en", 60))
    rows = []
    for i in range(160):
        lang = random.choice(["en", "de"])
        text = " ".join(draw(lang, random.randint(40, 200)))
        if i % 20 == 3:
            text += "\n" + passage + " tail " + " ".join(draw(lang, 30))
        rows.append((i, text, lang, "s", len(text)))
    rows += [(200 + k, rows[k][1], rows[k][2], "s", 1) for k in range(10)]
    rows += [(300 + k, " ".join(f"{w}###" for w in draw("en", 60)), "en", "s", 1) for k in range(8)]
    rows += [(400, None, "en", "s", 0), (401, "12 34 56", "en", "s", 8), (402, "too short", "en", "s", 9)]
    random.shuffle(rows)
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
    ids = lambda name: {r.doc_id for r in kept[name]}
    assert ids("language_id") == {r[0] for r in rows} - {400, 401}
    assert ids("quality_rules") == set(range(160)) | set(range(200, 210))
    texts = {r.doc_id: r.text for r in kept["quality_rules"]}
    assert ids("simhash_near_dedup") == set(brute_components({d: brute_print(t) for d, t in texts.items()}).values())
    assert not ids("simhash_near_dedup") & set(range(200, 210))
    seen = set()
    for r in sorted(kept["simhash_near_dedup"], key=lambda r: r.doc_id):
        w, gone = re.findall(r"[^\x20\x09-\x0D]+", r.text), set()
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone.update(range(i, i + 20))
            seen.add(tuple(w[i : i + 20]))
        got = next(x for x in kept["substring_dedup"] if x.doc_id == r.doc_id)
        assert got.text == (" ".join(x for i, x in enumerate(w) if i not in gone) if gone else r.text)
        assert got.n_chars == len(got.text)
    assert sum(passage in r.text for r in kept["substring_dedup"]) == 1
    pieces, fill = defaultdict(int), defaultdict(int)
    for r in kept["best_fit_packing"]:
        pieces[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert pieces.keys() == ids("substring_dedup") and max(fill.values()) <= 1024
    assert len(fill) <= -(-sum(fill.values()) // 1024) + 1


def test_run(spark, tmp_path):
    rows, _ = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans array<int>, n_words int, n_removed string, kept_text string, lang_pred int, score string, hash int, kept boolean, pattern int, posterior string, c0 string, fingerprint_bits long, base_failed string"
EXTRA = ([1, 2], 3, "a", "b", 4, "c", 5, False, 6, "d", "e", 7, "f")


def test_stages_on_odd_tables(spark):
    """Columns of clashing names keep their values; null ids, null texts and repeated rows pass through every stage; empty tables give empty ones."""
    rows, _ = corpus()
    rows = [(*r, *EXTRA) for r in [*rows, (None, rows[0][1], rows[0][2], "s", 5), (500, None, None, None, None), *[rows[1]] * 30]]
    whole = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, whole.limit(0), "").count() == 0
        out = stage(spark, whole, "")
        if name == "best_fit_packing":
            assert out.groupBy("doc_id").count().count() == len({r[0] for r in rows})
            continue
        assert out.schema == whole.schema
        found = out.collect()
        assert found and all(tuple(r)[5:] == EXTRA for r in found)
        given = {(r[0], r[1]) for r in rows}
        if name != "substring_dedup":
            assert {(r.doc_id, r.text) for r in found} <= given
        if name == "simhash_near_dedup":
            assert sum(r.doc_id == rows[-1][0] for r in found) <= 1 and any(r.doc_id is None for r in found)
        if name == "substring_dedup":
            assert len(found) == len(rows)


def test_run_computes_each_stage_once(spark, tmp_path, monkeypatch):
    rows, _ = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    log = str(tmp_path / "log")

    def counted(name, stage):
        def note(batches):
            for b in batches:
                with open(log, "a") as f:
                    f.write(f"{name} {b.num_rows}\n")
                yield b

        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            return out.mapInArrow(note, out.schema)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*s) for s in corpus_pipeline.STAGES])
    n = len(corpus_pipeline.run(spark, str(tmp_path)).collect())
    seen = defaultdict(int)
    for line in open(log):
        name, k = line.split()
        seen[name] += int(k)
    assert seen["language_id"] == len(rows) - 2 and seen["best_fit_packing"] == n
    assert seen["quality_rules"] == 170 and seen["simhash_near_dedup"] == seen["substring_dedup"] <= 160
