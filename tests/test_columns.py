"""Edge cases of the column expressions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veriset.functions import flags, names, vectors


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "name, expected",
    [
        ("uuid___RS_HL 6271.JPG", "rs_hl 6271"),
        ("x___RS_NLB 4044 copy 2.jpg", "rs_nlb 4044"),
        ("a_final_masked.png", "a"),
        ("b.Jpg", "b.jpg"),
        ("a___b___ C.PNG.jpeg\t", "c"),
        ("copycat.jpg", ""),
    ],
)
def test_object_identifier(spark, name, expected):
    assert one(spark, names.object_identifier(F.lit(name))) == expected


def test_display_and_readable_names_differ_on_a_second_separator(spark):
    assert one(spark, names.display_name(F.lit("A_b___c___d"))) == "A b - c - d"
    assert one(spark, names.readable_name(F.lit("A_b___c___d"))) == "A b - c   d"
    assert one(spark, names.readable_name(F.lit("plain_name"))) == "plain name"


def test_listed_paths(spark):
    assert one(spark, names.listed_class(F.lit("\\root\\Class_A\\File.JPG"))) == "Class_A"
    assert one(spark, names.listed_file(F.lit("/root/Class_A/File.JPG/"))) == "File.JPG"
    assert one(spark, names.listed_class(F.lit("only"))) is None
    assert one(spark, names.listed_file(F.lit("only"))) is None


def test_run_names(spark):
    assert one(spark, names.run_name_of_checkpoint(F.lit("a_best_run_best"))) == "a_best_run"
    assert one(spark, names.rate_token(F.lit(5e-4))) == "5em04"
    assert one(spark, names.rate_token(F.lit(20.0))) == "2ep01"
    assert one(spark, names.valid_run_name(F.lit("run-1_a"))) is True
    assert one(spark, names.valid_run_name(F.lit("_run"))) is False
    assert one(spark, names.percent_text(F.lit(0.98765))) == "98.77%"
    assert one(spark, names.percent_text(F.lit(None).cast("double"))) == "N/A"


def test_file_names(spark):
    import hashlib

    token = hashlib.sha1(b"p/q").hexdigest()[:10]
    assert one(spark, names.safe_filename(F.lit('a<b>:c?.jpg '), F.lit("p/q"))) == f"a_b__c___{token}.jpg"
    assert one(spark, names.safe_filename(F.lit("..."), F.lit("p/q"))) == f"image__{token}"
    assert one(spark, names.percent_encoded(F.lit("a b/c%20?~*.jpg"))) == "a%20b/c%2520%3F~%2A.jpg"


def test_group_key_prefers_the_object(spark):
    null = F.lit(None).cast("string")
    assert one(spark, names.group_key(F.lit("o"), F.lit("d"))) == "leaf::o"
    assert one(spark, names.group_key(null, F.lit("d"))) == "unmapped_hash::d"


def test_dhash_bits(spark):
    grid = [0.0] * 72
    assert one(spark, vectors.dhash_from_grid(F.array(*map(F.lit, grid)))) == 0
    grid[7 * 9 + 7] = 1.0  # last row, last comparison: bit 63
    assert one(spark, vectors.dhash_from_grid(F.array(*map(F.lit, grid)))) == -(2**63)
    descending = [float(9 - i % 9) for i in range(72)]
    assert one(spark, vectors.dhash_from_grid(F.array(*map(F.lit, descending)))) == -1


def test_hamming_counts_the_sign_bit(spark):
    assert one(spark, vectors.hamming64(F.lit(-1), F.lit(0))) == 64
    assert one(spark, vectors.hamming64(F.lit(-(2**63)), F.lit(1))) == 2


@pytest.mark.parametrize("count", [1, 5, 9, 64])
def test_shares_cover_all_bits_evenly(count):
    cut = vectors.shares(64, count)
    assert [bit for share in cut for bit in share] == list(range(64))
    assert len(cut) == count and max(map(len, cut)) - min(map(len, cut)) <= 1


@pytest.mark.parametrize("bands, threshold", [(5, 4), (6, 4), (9, 8), (10, 8)])
def test_band_masks_catch_every_close_pair(bands, threshold):
    rng = random.Random(bands)
    masks = vectors.band_masks(bands, bands - threshold)
    for _ in range(2000):
        difference = sum(1 << b for b in rng.sample(range(64), threshold))
        assert any(difference & m & (2**64 - 1) == 0 for m in masks)


def test_hash_bands_cover_all_bits(spark):
    value = -(2**63) + 12345
    row = one(spark, vectors.hash_bands(F.lit(value), 5))
    rebuilt, shift = 0, 0
    for band in row:
        rebuilt |= band.value << shift
        shift += band.size
    assert shift == 64 and vectors.signed64(rebuilt) == value


def test_argmax_and_rank_ties(spark):
    probs = F.array(*map(F.lit, [0.2, 0.4, 0.4]))
    assert one(spark, vectors.predicted_index(probs)) == 1
    assert one(spark, vectors.true_rank(probs, F.lit(2))) == 1
    assert one(spark, vectors.true_rank(probs, F.lit(1))) == 0
    assert one(spark, vectors.true_rank(probs, F.lit(0))) == 2


def test_losses(spark):
    assert one(spark, vectors.log_loss_term(F.lit(0.0))) == pytest.approx(-math.log(1e-12))
    assert one(spark, vectors.brier_term(F.array(F.lit(1.0), F.lit(0.0)), F.lit(1))) == pytest.approx(2.0)
    soft = one(spark, vectors.softmax(F.array(F.lit(1000.0), F.lit(1001.0))))
    assert soft == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])


def test_bins_are_left_closed_and_the_last_one_closed(spark):
    assert one(spark, vectors.bin_index(F.lit(0.0), 15)) == 0
    assert one(spark, vectors.bin_index(F.lit(1.0), 15)) == 14
    edge = vectors.bin_edges(15)[6]
    assert one(spark, vectors.bin_index(F.lit(edge), 15)) == 6
    assert one(spark, vectors.bin_index(F.lit(math.nextafter(edge, 0)), 15)) == 5


def test_vector_measures(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0))
    assert one(spark, vectors.cosine(a, b)) == pytest.approx(1.0)
    assert one(spark, vectors.mean_absolute_error(a, b)) == pytest.approx(3.5)
    assert one(spark, vectors.guarded_correlation(a, b)) == pytest.approx(1.0)
    assert one(spark, vectors.guarded_correlation(a, F.array(F.lit(2.0), F.lit(2.0)))) == 0.0
    assert one(spark, vectors.unit_vector(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_pixel_conditions(spark):
    flat = F.array(*[F.lit(100.0)] * 100)
    centre = one(spark, vectors.occlude_centre(flat, 10, 10))
    # the box 2..8 is filled with both edges, the kept box 2..7 excludes the far edges
    assert centre.count(128.0) == 49 and centre[22] == 128.0 and centre[88] == 128.0 and centre[89] == 100.0
    border = one(spark, vectors.occlude_border(flat, 10, 10))
    assert border.count(100.0) == 36 and border[77] == 100.0 and border[78] == 128.0
    assert one(spark, vectors.brightness(F.array(F.lit(200.0)), 1.4)) == [255.0]
    assert one(spark, vectors.contrast(F.array(F.lit(0.0), F.lit(201.0)), 0.5, F.lit(101.0))) == [50.5, 151.0]
    assert one(spark, vectors.rounded_mean(F.array(F.lit(0.0), F.lit(201.0)))) == 101.0


def test_flags(spark):
    assert one(spark, flags.strict_match(F.lit(4))) is True and one(spark, flags.strict_match(F.lit(5))) is False
    assert one(spark, flags.pixel_flag(F.lit(0.995), F.lit(0.03))) is True
    assert one(spark, flags.embedding_flag(F.lit(0.9899))) is False
    none = F.lit(None).cast("bigint")
    assert one(spark, flags.fallback_errors(none, none, F.lit(0.75), F.lit(10))) == 2  # 2.5 rounds to even
    assert one(spark, flags.fallback_errors(none, F.lit(7).cast("bigint"), F.lit(0.5), F.lit(10))) == 7
