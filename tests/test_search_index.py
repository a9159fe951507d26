"""Searches by trigram postings against scans of the whole timeline."""

import pytest
from pyspark.sql import functions as F

from streamloom import schema
from streamloom.operators import search
from streamloom.plans.fixtures import timeline
from streamloom.sources import readers, search_index
from streamloom.sources.search_index import TimelineIndex, write_index


@pytest.fixture(scope="module")
def indexed(spark, sf_dir, tmp_path_factory):
    before, search_index.BLOCK_ROWS = search_index.BLOCK_ROWS, 3
    path = str(tmp_path_factory.mktemp("index") / "own")
    rows = timeline(spark, sf_dir)
    write_index(rows, path)
    search_index.BLOCK_ROWS = before
    return rows, TimelineIndex(spark, path, schema.TIMELINE)


def _rows(df):
    return sorted((r.video_id, r.seg_ord) for r in df.collect())


@pytest.mark.parametrize("word", ["the", "er", "a", "CG", "not there at all", "?", "", "tion", " "])
def test_keywords_are_those_of_the_scan(indexed, word):
    rows, index = indexed
    assert _rows(index.by_keyword(word)) == _rows(search.by_keyword(rows, word))
    assert _rows(index.by_character(word)) == _rows(search.by_character(rows, word))
    assert _rows(index.by_chapter(word)) == _rows(search.by_chapter(rows, word))


def test_a_rare_word_reads_few_blocks(indexed, monkeypatch):
    rows, index = indexed
    text = rows.where("asr.text IS NOT NULL").select("asr.text").first()[0]
    found = index.by_keyword(text)
    assert found.count() >= 1 and index.blocks(["speech"], text).count() <= 0.2 * index.timeline.select("block").distinct().count()
    assert len(found.inputFiles()) <= len(index.timeline.inputFiles())
    monkeypatch.setattr(search_index, "BY_NAME", 0)
    assert _rows(index.by_keyword(text)) == _rows(found)
    assert index.candidates(["speech"], "the").where(F.lit(True)).count() <= rows.count()


def test_writing_an_index_leaves_the_timeline_as_it_was(spark, sf_dir, tmp_path):
    rows = timeline(spark, sf_dir)
    before = [c for c in rows.columns if c != "block"]
    write_index(rows, str(tmp_path / "own"))
    assert rows.columns == before and "block" not in before
    readers.write_timeline_arrays(rows, str(tmp_path / "arrays"))
    assert readers.read_timeline_arrays(spark, str(tmp_path / "arrays")).count() == rows.count()


def test_blocks_follow_segments_not_videos(spark, sf_dir, tmp_path):
    """Short videos share a block and its folder; a long one has several."""
    rows = timeline(spark, sf_dir)
    write_index(rows, str(tmp_path / "own"))
    index = TimelineIndex(spark, str(tmp_path / "own"), schema.TIMELINE)
    assert index.timeline.select("block").distinct().count() == 1 < rows.select("video_id").distinct().count()
    assert index.timeline.drop("block").exceptAll(rows).isEmpty() and index.timeline.count() == rows.count()
    one = rows.where("seg_ord = 0").withColumns({"video_id": F.lit(1).cast("long"), "seg_ord": F.explode(F.array(*map(F.lit, range(0, 40_000, 2_000))))})
    write_index(one, str(tmp_path / "long"))
    long = TimelineIndex(spark, str(tmp_path / "long"), schema.TIMELINE).timeline
    assert long.groupBy("video_id", F.floor(F.col("seg_ord") / search_index.BLOCK_ROWS)).agg(F.count_distinct("block").alias("n")).where("n > 1").isEmpty()
