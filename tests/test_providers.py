"""Table functions, the ledger of answers and the page files: against plain calls, with killed jobs, retries and odd rows."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import documents, pixels, tablefunctions
from foliospark.operators.ledger import Ledger
from foliospark.plans import registry
from foliospark.sources import pagejson

DATA = "/root/testdata/sf0.001"


# Table functions.


def reader():
    def read(page):
        return [([(0, 0), (page.shape[1], 0)], f"mean {int(page.mean())}", 0.5), ([(1, 1)], "é")]

    return read


def some_images(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i, channels in enumerate((3, 1, 3)):
        page = np.full((120, 160, channels), 255, np.uint8)
        page[20:40, 10 : 60 + 20 * i] = rng.integers(0, 60, (20, 50 + 20 * i, channels), np.uint8)
        rows.append((i, 120, 160, channels, page.tobytes(), f"file {i}"))
    return spark.createDataFrame(rows, "image_id long, height int, width int, channels int, data binary, origin string")


def halves(page):
    return [(0, 0, 80, 60), (80, 0, 80, 120)]


@pytest.mark.parametrize("regions", [None, halves])
def test_a_recogniser_in_sql_gives_what_the_callable_gives(spark, regions):
    images = some_images(spark)
    images.createOrReplaceTempView("some_images")
    tablefunctions.register_recogniser(spark, "ocr", reader, regions)
    columns = ["image_id", "roi_x", "roi_y", "box", "text", "confidence"]
    want = pixels.recognise(images, reader, regions or pixels.text_rois).select(columns)
    plain = spark.sql("select * from ocr(table(some_images))")
    assert plain.columns == ["image_id", "origin", *columns[1:]]
    by_page = spark.sql("select o.* from ocr(table(select image_id, height, width, channels, data from some_images) partition by image_id) o where confidence > 0")
    for got in (plain, by_page):
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.collect()))
    assert spark.sql("select * from ocr(table(select * from some_images where image_id < 0))").count() == 0
    assert spark.sql("select * from ocr(table(select image_id, height, width, channels, cast(null as binary) as data from some_images))").count() == 0


def test_a_recogniser_names_what_it_needs(spark):
    tablefunctions.register_recogniser(spark, "ocr", reader)
    with pytest.raises(Exception, match="data"):
        spark.sql("select * from ocr(table(select 1 as height, 2 as width, 3 as channels))").collect()
    with pytest.raises(Exception, match="confidence"):
        spark.sql("select * from ocr(table(select 1 as height, 2 as width, 3 as channels, binary('') as data, 1 as Confidence))").collect()


def broken():
    def call(prompt):
        if prompt == "bad":
            raise RuntimeError("no answer")
        return prompt.upper()

    return call


def test_a_model_in_sql(spark):
    spark.createDataFrame([(1, "a", None), (1, "é☃", 2), (2, None, 3), (2, "bad", 4)], "page long, prompt string, x int").createOrReplaceTempView("some_prompts")
    tablefunctions.register_model(spark, "ask", broken, "null")
    got = spark.sql("select * from ask(table(some_prompts) partition by page order by (x), 'prompt')")
    assert got.columns == ["page", "prompt", "x", "response"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", None, "A"), (1, "é☃", 2, "É☃"), (2, None, 3, None), (2, "bad", 4, None)], key=str)
    # The rows of a provider that SQL joins, filters and groups like any table's.
    assert spark.sql("select count(response) as n from ask(table(some_prompts), 'prompt')").first().n == 2
    tablefunctions.register_model(spark, "ask_all", broken)
    with pytest.raises(Exception, match="no answer"):
        spark.sql("select * from ask_all(table(some_prompts), 'prompt')").collect()
    for wrong in ("'nothing'", "concat('pro', cast(rand() as string))"):
        with pytest.raises(Exception, match="one of its columns"):
            spark.sql(f"select * from ask(table(some_prompts), {wrong})").collect()


# The ledger.


def counting(root, dies_after=None):
    """A provider that notes each question in a file of its own, and fails once there are so many."""

    def make():
        def call(prompt):
            import os
            import uuid

            os.makedirs(root, exist_ok=True)
            if dies_after is not None and len(os.listdir(root)) >= dies_after:
                raise RuntimeError("killed")
            with open(f"{root}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            return f"answer to {prompt}"

        return call

    return make


def asked(root):
    return sorted(open(f).read() for f in glob.glob(f"{root}/*"))


@pytest.fixture
def prompts(spark):
    rows = [(i, f"question {i % 20}") for i in range(60)] + [(None, "é☃"), (61, None), (62, "")]
    return spark.createDataFrame(rows, "id long, prompt string").withColumns({"digest": F.lit("x"), "of": F.lit(2)}).repartition(3)


def answers(df):
    return sorted(((r.id, r.prompt, r.response) for r in df.collect()), key=str)


def test_equal_prompts_are_asked_once_and_known_ones_never(spark, prompts, tmp_path):
    ledger, calls = Ledger(str(tmp_path / "ledger")), str(tmp_path / "calls")
    want = sorted(((r.id, r.prompt, None if r.prompt is None else f"answer to {r.prompt}") for r in prompts.collect()), key=str)
    got = ledger.answered(prompts, counting(calls), concurrency=2)
    assert got.columns == ["id", "prompt", "digest", "of", "response"] and answers(got) == want
    assert asked(calls) == sorted(["é☃", ""] + [f"question {i}" for i in range(20)])
    assert answers(ledger.answered(prompts, counting(calls, 0))) == want
    more = prompts.union(spark.createDataFrame([(70, "new", "x", 2), (71, "new", "x", 2)], prompts.schema))
    assert answers(ledger.answered(more, counting(calls))) == sorted([*want, (70, "new", "answer to new"), (71, "new", "answer to new")], key=str)
    assert len(asked(calls)) == 23
    assert ledger.answered(prompts.where("false"), counting(calls)).count() == 0


def test_a_job_that_is_killed_half_way_asks_nothing_twice(spark, prompts, tmp_path):
    ledger, calls = Ledger((tmp_path / "ledger").as_uri()), str(tmp_path / "calls")
    with pytest.raises(Exception, match="killed"):
        ledger.answered(prompts, counting(calls, 9), concurrency=2)
    before = asked(calls)
    assert 9 <= len(before) < 22 and ledger.answers(spark).count() == len(before)
    got = answers(ledger.answered(prompts, counting(calls), concurrency=3))
    assert all(r[2] == (None if r[1] is None else f"answer to {r[1]}") for r in got)
    # 22 questions, each once over both jobs.
    assert len(asked(calls)) == len(set(asked(calls))) == 22
    assert not os.path.exists(tmp_path / "ledger" / "objects")


def test_a_task_that_is_tried_again_asks_nothing_twice(tmp_path):
    """In a session of its own, in which tasks may fail: the first try is lost after some answers."""
    import subprocess
    import sys

    code = f"""
import os, sys
sys.path[:0] = {[os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]!r}
os.environ["PYTHONPATH"] = os.pathsep.join(sys.path[:2])
from pyspark.sql import SparkSession
from foliospark.operators.ledger import Ledger
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
def provider():
    def call(prompt):
        from pyspark import TaskContext
        open({str(tmp_path / "calls")!r}, "a").write(prompt + "\\n")
        if prompt == "q5" and TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost")
        return prompt + "!"
    return call
df = spark.createDataFrame([(f"q{{i}}",) for i in range(12)], "prompt string")
rows = Ledger({str(tmp_path / "ledger")!r}).answered(df, provider, concurrency=1).collect()
assert sorted(r.response for r in rows) == sorted(f"q{{i}}!" for i in range(12))
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=240, capture_output=True)
    calls = open(tmp_path / "calls").read().split()
    assert sorted(calls) == sorted([f"q{i}" for i in range(12)] + ["q5"])


def test_failed_requests_stay_open(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "ledger"))
    prompts = spark.createDataFrame([("good",), ("bad",)], "prompt string")
    assert {r.prompt: r.response for r in ledger.answered(prompts, broken, on_error="null").collect()} == {"good": "GOOD", "bad": None}
    assert {r.prompt: r.response for r in ledger.answered(prompts, lambda: str.title).collect()} == {"good": "GOOD", "bad": "Bad"}
    with pytest.raises(ValueError):
        ledger.answered(prompts, broken, on_error="other")


# Files of pages.


def written(path):
    return {os.path.basename(f): open(f, "rb").read() for f in glob.glob(f"{path}/part-*/*")}


def test_region_texts_as_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(1, ["héllo ☃   \"quoted\" \\ back", "line\nbreak\ttab", ""]), (2, []), (3, ["𝄞 </b> \x01 & ü"])]
    texts = spark.createDataFrame(rows, "image_id long, texts array<string>").repartition(3)
    pagejson.write_region_texts(texts, path)
    want = {f"{i}.ocr_results.json": json.dumps(t, indent=2, ensure_ascii=False).encode() for i, t in rows}
    assert written(path) == want
    # In place of what was there, and nothing else left behind.
    pagejson.write_region_texts(texts.where("image_id = 2"), path)
    assert written(path) == {"2.ocr_results.json": b"[]"} and os.listdir(tmp_path) == ["out"]
    pagejson.write_region_texts(texts.where("false"), (tmp_path / "none").as_uri())
    assert written(tmp_path / "none") == {}


def test_vision_documents_as_files(spark, tmp_path):
    path = str(tmp_path / "out")
    boxes = spark.createDataFrame([(1, 1, 22, 98, 1966, 1472), (1, 3, 0, 1500, 40, 1600), (2, 1, 1, 2, 3, 4)], "image_id long, group_id long, left_x long, top_y long, right_x long, bottom_y long")
    said = spark.createDataFrame([(1, 1, "A \"pot\".\n\nTwo é"), (1, 3, ""), (2, 1, None)], "image_id long, group_id long, description string")
    paragraphs = spark.createDataFrame([(1, 1, 2, "second"), (1, 1, 1, "first 。")], "image_id long, group_id long, para_no long, text string")
    pagejson.write_vision_documents(documents.vision_documents(boxes, said, paragraphs), path)

    def region(i, top, bottom, left, right, text, merged):
        bounds = {"top": top, "bottom": bottom, "left": left, "right": right}
        return {"region_id": i, "bounds": bounds, "vision_description": text, "text_content": {"columns": [], "merged_paragraphs": merged}}

    first = {"total_regions": 2, "regions": [region(1, 98, 1472, 22, 1966, "A \"pot\".\n\nTwo é", ["first 。", "second"]), region(3, 1500, 1600, 0, 40, "", [])]}
    second = {"total_regions": 1, "regions": [region(1, 2, 4, 1, 3, None, [])]}
    assert written(path) == {f"{i}.vision_analysis_results.json": json.dumps(d, indent=2, ensure_ascii=False).encode() for i, d in ((1, first), (2, second))}


def test_files_of_whole_tables_and_appended_ones(spark, tmp_path):
    texts = documents.page_texts(registry.l2_paragraphs(spark, DATA)).persist()
    path = str(tmp_path / "out")
    pagejson.write_region_texts(texts, path)
    assert written(path) == {f"{r.image_id}.ocr_results.json": json.dumps(r.texts, indent=2, ensure_ascii=False).encode() for r in texts.collect()}
    n = len(written(path))
    spark.createDataFrame([(-5, '{"a":1}')], "image_id long, document string").write.format("page_json").option("name", "x.json").mode("append").save(path)
    assert len(written(path)) == n + 1 and written(path)["-5.x.json"] == b'{\n  "a": 1\n}'
    texts.unpersist()


def test_a_failed_job_leaves_the_files_as_they_were(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "[1]"), (2, "[2]")], "image_id long, document string")
    pagejson.write_documents(rows, path, "x.json")
    before = written(path)
    with pytest.raises(Exception):
        pagejson.write_documents(rows.union(spark.createDataFrame([(3, "not JSON")], rows.schema)), path, "x.json")
    assert written(path) == before and os.listdir(tmp_path) == ["out"]
