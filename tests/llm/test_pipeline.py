"""The pipeline's stages against what each should keep."""

import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from transferlake.llm import common  # noqa: E402

from .test_operators import SF, brute_components, brute_fingerprint, check_pieces  # noqa: E402


def test_stages_keep_and_drop_what_they_should(spark):
    docs = common.table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "toxicity", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    before = {r.doc_id: r.text for r in docs.collect()}
    held = docs
    for name in list(stages)[:-1]:
        held = common.checkpointed(stages[name](spark, held, SF))
        assert held.columns == docs.columns
        after = {r.doc_id: r.text for r in held.collect()}
        assert after.items() <= before.items()
        gone = before.keys() - after.keys()
        if name == "language_id":
            assert len(gone) <= 0.03 * len(before)
        if name == "simhash_near_dedup":
            component = brute_components({i: brute_fingerprint(t) for i, t in before.items()})
            assert after.keys() == set(component.values())
        if name == "benchmark_decontamination":
            plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
            items = [plain(r.text) for r in common.table(spark, SF, "benchmark").collect()]
            assert gone == {i for i, t in before.items() if any(b in plain(t) for b in items)}
        before = after
    check_pieces(spark, before, stages["packing"](spark, held, SF).collect())


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_rows_that_share_an_id_are_judged_apart(spark):
    stages = dict(corpus_pipeline.STAGES)
    item = common.table(spark, SF, "benchmark").first().text
    clean = ["the quiet river runs past a mill and an old stone bridge", "seven engineers repaired the northern railway line during winter"]
    docs = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda name, rows: sorted(r.text for r in stages[name](spark, docs(rows), SF).collect())
    words = " ".join(clean).split()
    teachers = [(k, " ".join(words[(k * i) % len(words)] for i in range(1, 9 + k % 7))) for k in range(10, 60)]  # texts that differ, so that what is usual has a spread
    assert kept("language_id", [(None, "12 34"), (None, clean[0]), (5, "56"), (5, clean[1]), *teachers]) == sorted([*clean, *(t for _, t in teachers)])
    assert kept("benchmark_decontamination", [(None, item), (None, clean[0]), (5, item), (5, clean[1])]) == sorted(clean)
    assert kept("simhash_near_dedup", [(1, clean[0]), (2, clean[0]), (2, clean[1]), (None, clean[0]), (3, item), (3, item)]) == sorted([*clean, item])
    assert kept("simhash_near_dedup", [(None, clean[0]), (None, clean[0]), (None, clean[1])]) == sorted(clean)


def test_every_stage_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, an empty table and columns that clash with those of the stages."""
    stages = dict(corpus_pipeline.STAGES)
    item = common.table(spark, SF, "benchmark").first().text
    given = common.table(spark, SF, "documents").where("text is not null").orderBy("doc_id").limit(120).collect()
    sentence, other = given[0].text, given[1].text
    base = 10**12
    rows = [
        (None, None, None, None, None),
        (base, "", "en", "s", 0),
        (base + 1, " \n ", None, None, None),
        (base + 2, "12 34 !", "en", "s", None),
        (base + 3, (other + " ") * (1_000_000 // len(other)), "en", None, 1),
        (base + 4, sentence, None, "s", -1),
        (base + 4, sentence, None, "s", -1),
        (None, sentence + " " + other, "en", "s", 3),
        (base + 5, item, "en", "s", 4),
        *((base + 10 + k, r.text, r.lang, r.source, r.n_chars) for k, r in enumerate(given)),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ("row_key", "rejected", "id", "fp", "component_id", "row", "hash", "grade", "truth", "pred", "toxic")
    docs = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], f"{schema}, {', '.join(f'{c} string' for c in extra)}")
    kept = {}
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS
        kept[name] = [tuple(r) for r in out.collect()]
        assert stages[name](spark, docs.where("false"), SF).count() == 0
    count = lambda rows: Counter(map(repr, rows))
    lettered = count(r for r in rows if r[1] and any(map(str.isalpha, r[1])))
    assert count(kept["language_id"]) <= lettered and len(kept["language_id"]) >= 0.97 * lettered.total()
    assert all(n in (0, lettered[r]) for r, n in count(kept["language_id"]).items())
    assert count(kept["toxicity"]) == count(rows)
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [plain(r.text) for r in common.table(spark, SF, "benchmark").collect()]
    assert count(kept["benchmark_decontamination"]) == count(r for r in rows if not any(b in plain(r[1]) for b in items))
    fingerprint = {k: brute_fingerprint(r[1]) for k, r in enumerate(rows)}
    groups = {}
    for k, c in brute_components(fingerprint).items():
        groups.setdefault(c, []).append(rows[k])
    first = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert count(kept["simhash_near_dedup"]) == count(first)
    packed = stages["packing"](spark, docs, SF).collect()
    check_pieces(spark, {r[0]: r[1] for r in rows if r[0] not in (None, base + 4)}, [r for r in packed if r.doc_id not in (None, base + 4)], gapless=False)
    starts = Counter((r.doc_id, r.start == 0) for r in packed)
    assert starts[None, True] == 2 and starts[base + 4, True] == 2
    assert stages["packing"](spark, docs.where("false"), SF).count() == 0
