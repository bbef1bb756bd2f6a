"""Pixel kernels on drawn images, within tolerances."""

import numpy as np
import pytest

from foliospark.operators import pixels


def page(boxes, h=200, w=300, paper=255, ink=0):
    image = np.full((h, w), paper, np.uint8)
    for x, y, bw, bh in boxes:
        image[y : y + bh, x : x + bw] = ink
    return image


def test_components_are_eight_connected():
    mask = np.zeros((6, 8), np.uint8)
    mask[1, 1] = mask[2, 2] = mask[3, 1] = 255
    mask[4:6, 5:8] = 255
    assert pixels.components(mask) == [(1, 1, 2, 3, 3), (5, 4, 3, 2, 6)]
    assert pixels.components(np.zeros((3, 3), np.uint8)) == []


def test_outer_outlines_have_no_inner_parts():
    frame = page([(10, 10, 100, 80)], paper=0, ink=255)
    frame[12:88, 12:108] = 0
    frame[40:50, 40:60] = 255
    assert pixels.outlines(frame) == [(10, 10, 100, 80, 99.0 * 79)]
    assert (pixels.filled(frame)[10:90, 10:110] == 255).all() and pixels.filled(frame).sum() == 255 * 8000
    line = page([(5, 5, 40, 1), (60, 60, 1, 1)], paper=0, ink=255)
    line[100:110, 100] = line[100, 100:120] = 255
    assert pixels.outlines(line) == [(5, 5, 40, 1, 0.0), (60, 60, 1, 1, 0.0), (100, 100, 20, 10, 0.5)]
    # A gap in the frame at a corner keeps the ground apart, as the frame's pixels still touch.
    frame[10, 10] = 0
    assert [o[:4] for o in pixels.outlines(frame)] == [(10, 10, 100, 80)]
    assert pixels.outlines(np.zeros((3, 3), np.uint8)) == []


def test_morphology_closes_gaps_and_opens_specks():
    mask = page([(20, 20, 30, 10), (52, 20, 30, 10), (150, 150, 2, 2)], paper=0, ink=255)
    assert len(pixels.components(pixels.close(mask, 5))) == 2
    assert len(pixels.components(pixels.open_(mask, 5))) == 2


def test_text_rois_surround_text_within_the_page():
    found = pixels.text_rois(page([(40, 50, 60, 12), (200, 120, 60, 12)]))
    assert len(found) == 2
    for (x, y, w, h), (tx, ty, tw, th) in zip(found, [(40, 50, 60, 12), (200, 120, 60, 12)]):
        assert x <= tx and y <= ty and x + w >= tx + tw and y + h >= ty + th
        assert x >= 0 and y >= 0 and x + w <= 300 and y + h <= 200


def test_edges_of_a_box():
    edges = pixels.canny(page([(60, 50, 100, 80)]), 50, 150) > 0
    ys, xs = np.nonzero(edges)
    assert abs(xs.min() - 60) <= 1 and abs(xs.max() - 159) <= 1 and abs(ys.min() - 50) <= 1 and abs(ys.max() - 129) <= 1
    assert edges.mean() < 0.02
    assert pixels.edge_density(page([])) == 0.0


def test_object_candidates_find_a_picture():
    found = pixels.object_candidates(page([(60, 50, 100, 80)]), np.zeros((200, 300), np.uint8))
    assert {f[0] for f in found} == set(pixels.SCALES)
    assert all(abs(x / s - 60) < 4 and abs(w / s - 100) < 6 and text == 0 for s, x, _, w, _, _, text in found)


def test_image_blocks_need_edges_and_size():
    rng = np.random.default_rng(1)
    image = np.full((300, 400), 255, np.uint8)
    image[100:220, 100:260] = rng.integers(0, 255, (120, 160))
    found = pixels.image_blocks(image, np.zeros_like(image))
    assert len(found) == 1 and abs(found[0][0] - 100) < 12 and abs(found[0][3] - 220) < 12
    assert pixels.image_blocks(image, np.full_like(image, 255)) == []


@pytest.mark.parametrize("angle", [0, 90, 30])
def test_rotation_canvas_and_content(angle):
    image = page([(140, 90, 20, 20)])
    turned = pixels.rotated(image, angle)
    from foliospark.operators.recognition import rotated_canvas

    assert turned.shape[::-1] == rotated_canvas(300, 200, angle)
    ys, xs = np.nonzero(turned < 128)
    assert abs(xs.mean() - turned.shape[1] / 2) < 2 and abs(ys.mean() - turned.shape[0] / 2) < 2


def test_segments_of_a_line():
    found = pixels.segments(page([(50, 100, 150, 3)]))
    assert found and all(abs(y2 - y1) <= 3 for _, y1, _, y2 in found[:1])
    assert pixels.segments(page([])) == []


def test_contrast_and_noise():
    rng = np.random.default_rng(2)
    image = (128 + rng.normal(0, 3, (64, 64))).clip(0, 255).astype(np.uint8)
    assert pixels.denoised(image).std() < image.std()
    assert pixels.equalized(image, 4.0).std() > image.std()
    assert set(np.unique(pixels.text_image(page([(10, 10, 20, 10)], 48, 64)))) <= {0, 255}
    assert abs(int(pixels.resized(image, 32, 32).mean()) - int(image.mean())) <= 1


def test_mask_of_boxes_is_half_open():
    assert pixels.mask_of_boxes(10, 10, [(2, 3, 5, 6), (-4, -4, 1, 1)]).sum() == 255 * (9 + 1)


def test_recognition_over_image_rows(spark):
    image = page([(40, 50, 60, 12)])
    rows = [(7, 200, 300, 3, bytearray(np.repeat(image[..., None], 3, 2).tobytes()))]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, channels int, data binary")

    def provider():
        return lambda roi: [([[0, 0], [roi.shape[1], 0], [roi.shape[1], roi.shape[0]], [0, roi.shape[0]]], "label")]

    found = pixels.recognise(df, provider).collect()
    assert [(r.image_id, r.text, r.confidence) for r in found] == [(7, "label", 0.8)]
    assert pixels.rois(df).count() == 1


def test_streamed_pages(spark, tmp_path):
    import json

    from foliospark.sources.layout import ELEMENTS
    from foliospark.streaming import ingest

    (tmp_path / "in").mkdir()
    row = {"image_id": 1, "element_id": 1, "type": "text", "text": "a line", "confidence": 1.0, "left_x": 0, "top_y": 0, "right_x": 9, "bottom_y": 9}
    (tmp_path / "in" / "a.json").write_text(json.dumps(row))
    stream = ingest.element_stream(spark, str(tmp_path / "in"), ELEMENTS)
    ingest.write_paragraphs(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a line"]
    assert ingest.image_stream(spark, str(tmp_path / "in")).isStreaming
