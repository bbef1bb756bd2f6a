"""Images to documents with stub providers."""

import base64
import json
import zlib

import numpy as np
from pyspark.sql import functions as F

from foliospark.operators import vision
from foliospark.plans import pages

H, W = 300, 300


def image():
    page = np.full((H, W), 255, np.uint8)
    page[20:32, 30:120] = 0
    page[20:32, 160:280] = 0
    page[150:270, 60:220] = np.kron(np.random.default_rng(3).integers(0, 2, (15, 20)), np.full((8, 8), 200))
    return page


def rows(spark):
    data = bytearray(np.repeat(image()[..., None], 3, 2).tobytes())
    return spark.createDataFrame([(5, H, W, 3, data)], "image_id long, height int, width int, channels int, data binary")


def reader():
    def read(roi):
        h, w = roi.shape
        return [([[0, 0], [w, 0], [w, h], [0, h]], ("wide open" if w > 112 else "narrow path") if h < 60 else "x", 0.9)]

    return read


def model():
    return lambda prompt: json.dumps({"choices": [{"message": {"content": f"{len(json.loads(prompt)['messages'])} message"}}]})


def test_png_round_trip():
    pixels = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    raw = vision.png(pixels)
    at = raw.index(b"IDAT")
    size = int.from_bytes(raw[at - 4 : at], "big")
    lines = np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + size]), np.uint8).reshape(4, 16)
    assert (lines[:, 1:].reshape(4, 5, 3) == pixels[..., ::-1]).all() and raw.startswith(b"\x89PNG")


def test_elements_of_an_image(spark):
    found = pages.elements(rows(spark), reader).collect()
    assert sum(r.type == "text" for r in found) >= 2
    pictures = [r for r in found if r.type == "image"]
    assert pictures and all(abs(r.left_x - 60) < 20 and abs(r.bottom_y - 270) < 20 for r in pictures)
    assert len({r.element_id for r in found}) == len(found)
    assert pages.image_blocks_by_shape(rows(spark), pages.text_blocks(rows(spark), reader).where("text = 'none'")).count() == 1


def test_documents_of_an_image(spark):
    made = pages.page_documents(rows(spark), reader, model).first()
    assert made.total_regions == len(made.regions) >= 1
    assert all(r.vision_description == "1 message" for r in made.regions)
    assert any("wide" in p for r in made.regions for p in r.text_content.merged_paragraphs)


def test_crops_leave_out_empty_regions(spark):
    boxes = spark.createDataFrame([(5, 1, -5, 0, 10, 10), (5, 2, 400, 0, 500, 10), (5, 3, 10, 10, 10, 40)], "image_id long, group_id long, left_x long, top_y long, right_x long, bottom_y long")
    found = vision.crops(rows(spark), boxes, lambda p: bytes(p.shape)).collect()
    assert [(r.group_id, bytes(r.picture)) for r in found] == [(1, bytes([10, 10, 3]))]
    asked = vision.documents.region_prompts(vision.crops(rows(spark), boxes))
    url = json.loads(asked.first().prompt)["messages"][0]["content"][1]["image_url"]
    assert url.startswith("data:image/jpeg;")
    sent = spark.createDataFrame([(5, 3, 10, 10, 10, 40), (5, 4, 0, 0, 9, 9)], boxes.schema)
    told = vision.described(rows(spark), sent, lambda: lambda p: json.dumps({"choices": [{"message": {"content": json.loads(p)["messages"][0]["content"][1]["image_url"][:15]}}]}))
    assert [(r.group_id, r.description) for r in told.collect()] == [(4, "data:image/png;")]
    assert base64.b64decode(url.split(",")[1]).startswith(b"\x89PNG")


def test_summaries_and_similarity(spark):
    told = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "image_id long, group_id long, description string")
    assert vision.summarised(told, model).first().analysis == "1 message"

    def broken():
        def call(prompt):
            raise OSError

        return call

    assert vision.summarised(told, broken).first().analysis == "Error generating final analysis"
    embed = lambda: lambda text: np.array([text.count("a"), text.count("b")], float)
    got = spark.createDataFrame([("Aa", "a"), ("a", "b"), ("c", "a")], "x string, y string").select(vision.semantic_similarity(F.col("x"), F.col("y"), embed).alias("s"))
    assert [round(r.s, 6) for r in got.collect()] == [1.0, 0.0, 0.0]
    assert told.select(vision.semantic_similarity(F.col("description"), F.col("description")).alias("s")).first().s == 0.0


def test_turned_pages_are_read_and_turned_back(spark):
    """A reader that sees the ink of the page it is given."""

    def seeing():
        def read(page):
            ys, xs = np.nonzero(page[40:-40, 40:-40] < 128)
            box = [[xs.min() + 40, ys.min() + 40], [xs.max() + 40, ys.min() + 40], [xs.max() + 40, ys.max() + 40], [xs.min() + 40, ys.max() + 40]]
            return [(box, " turned "), (box, "x", 0.9), (box, "unsure", 0.2)]

        return read

    page = np.full((H, W, 3), 255, np.uint8)
    page[100:140, 80:220] = 0
    images = spark.createDataFrame([(5, H, W, 3, bytearray(page.tobytes()))], "image_id long, height int, width int, channels int, data binary")
    angles = spark.createDataFrame([(5, 0.0), (5, 180.0)], "image_id long, angle double")
    found = pages.rotated_text_blocks(images, angles, seeing).collect()
    assert [(r.text, r.confidence, r.rotation) for r in sorted(found, key=lambda r: r.rotation)] == [("turned", 0.8, 0.0), ("turned", 0.8, 180.0)]
    assert all(max(abs(r.left_x - 80), abs(r.top_y - 100), abs(r.right_x - 219), abs(r.bottom_y - 139)) <= 4 for r in found)


def test_regions_and_elements_are_drawn(spark):
    from foliospark.operators import drawing

    images = spark.createDataFrame([(5, 100, 120, 1, bytearray(b"\xff" * 12000)), (6, 4, 4, 1, bytearray(b"\x07" * 16))], "image_id long, height int, width int, channels int, data binary")
    box = "left_x long, top_y long, right_x long, bottom_y long"
    regions = spark.createDataFrame([(5, 1, 10, 10, 110, 90)], f"image_id long, region_no long, {box}")
    elements = spark.createDataFrame([(5, 1, 1, "text", 20, 20, 60, 40), (5, 2, 1, "image", 70, 50, 100, 80), (5, 3, 1, "text", -5, -5, 3, 3)], f"image_id long, element_id long, region_no long, type string, {box}")
    made = {r.image_id: np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, 3) for r in drawing.drawn(images, drawing.region_shapes(regions, elements)).collect()}
    page = made[5]
    assert page[30, 40].tolist() == [204, 255, 204] and page[20, 40].tolist() == [0, 255, 0] and page[65, 70].tolist() == [0, 0, 255]
    assert page[65, 85].tolist() == [255, 255, 255] and page[10, 12].tolist() == [255, 0, 0] and page[10, 35].tolist() == [255, 255, 255]
    assert (made[6] == 7).all()
    groups = regions.withColumnRenamed("region_no", "group_id")
    page = np.frombuffer(bytes(drawing.drawn(images.where("image_id = 5"), drawing.group_shapes(groups, elements)).first().data), np.uint8).reshape(100, 120, 3)
    assert page[10, 12].tolist() == [0, 165, 255] and page[20, 25].tolist() == [0, 255, 0] and page[50, 75].tolist() == [0, 0, 255] and page[30, 40].tolist() == [255] * 3


def test_dump_and_report(spark):
    from foliospark.operators import documents

    box = "left_x long, top_y long, right_x long, bottom_y long"
    elements = spark.createDataFrame([(5, 2, 1, "text", "b", 0.5, 0, 9, 5, 12), (5, 1, 1, "text", "a", 0.9, 0, 0, 5, 5), (5, 3, 2, "image", None, 0.4, 0, 90, 5, 99)], f"image_id long, element_id long, group_id long, type string, text string, confidence double, {box}")
    boxes = spark.createDataFrame([(5, 1, 0, 0, 5, 12), (5, 2, 0, 90, 5, 99)], f"image_id long, group_id long, {box}")
    paragraphs = spark.createDataFrame([(5, 1, 2, "two"), (5, 1, 1, "one"), (5, 4, 1, "three")], "image_id long, group_id long, para_no long, text string")
    made = json.loads(documents.as_json(documents.region_dump(elements, boxes, paragraphs)).first().document)["regions"]
    assert [(r["region_id"], [e["element_id"] for e in r["elements"]], r["merged_paragraphs"]) for r in made] == [(1, [1, 2], ["one", "two"]), (2, [3], [])]
    assert made[0]["bounds"] == {"left": 0, "right": 5, "top": 0, "bottom": 12} and made[0]["elements"][0]["bounds"]["bottom"] == 5
    said = []
    documents.print_report(paragraphs, said.append)
    assert said == ["Region Group 1 (ID=1):", "  Paragraph 1: one", "  Paragraph 2: two", "Region Group 2 (ID=4):", "  Paragraph 1: three"]
