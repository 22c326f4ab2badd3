import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.unicode import nfkc
from quillspark.shipping import ship


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    "f, given, expected",
    [
        (T.slugify, "  Äx & Y--z ", "x-y-z"),
        (T.slugify, "!!", "unknown"),
        (T.normalize_term, "  Sample\t  Magic ", "sample magic"),
        (T.fix_ligatures, "ﬁle ﬂower", "file flower"),
        (T.clean_whitespace, "  hello   world  ", "hello world"),
        (T.collapse_blank_lines, "a\n\n\n\n\nb", "a\n\nb"),
        (T.merge_paragraphs, "This is a long\nsentence that was broken.", "This is a long sentence that was broken."),
        (T.merge_paragraphs, "# Head\ntext\n- item\n- more", "# Head\ntext\n- item\n- more"),
        (T.merge_paragraphs, "```\na\nb\n```\nafter", "```\na\nb\n``` after"),
        (T.cleanup_page, "  hello   world  \n\n\n\nsecond", "hello world\n\nsecond"),
        (T.scientific_notation, "10^‒43", "10^-43"),
        (T.scientific_notation, "10‒43", "10-43"),
        (T.scientific_notation, "2022–2023", "2022-2023"),
        (T.safe_file_name, ' a/b:"c"?.. ', "a_b__c__"),
        (T.escape_html, "<a href='x'>&\"", "&lt;a href=&#039;x&#039;&gt;&amp;&quot;"),
        (T.hex_to_rgb, "#1aFF00", "26,255,0"),
        (T.display_time, "", "-"),
        (T.display_time, "soon", "soon"),
        (T.display_time, "2024-01-02T03:04:05", "2024-01-02 03:04:05"),
        (T.answer_paragraphs, "a\nb\n\nc", "<p>a<br>b</p><p>c</p>"),
        (T.mime_type, "x.JPG", "image/jpeg"),
        (T.safe_stem, "my file.v1.pdf", "my_file.v1"),
    ],
)
def test_values(spark, f, given, expected):
    assert one(spark, f, given) == expected


def test_tokens_and_estimates(spark):
    assert one(spark, T.tokens, " A b C ") == ["a", "b", "c"]
    assert one(spark, T.query_words, "What is the BM25 of it, it?") == ["what", "the", "bm25"]
    assert one(spark, T.estimate_tokens, "abcde") == 2 and one(spark, T.estimate_tokens, "") == 0
    assert one(spark, T.model_id, "m", "p") == "p/m" and one(spark, T.model_id, "a/m", "p") == "a/m"


def test_poor_and_image_pages(spark):
    assert one(spark, T.poor_text, "few words") is True
    assert one(spark, T.is_image_page, " /a/b.PNG ") is True
    assert one(spark, T.is_image_page, "see a.png\nhere") is False
    assert one(spark, lambda c: T.image_path(c, F.lit(None).cast("string"), F.lit("/d")), "a.png") == "/d/a.png"


@pytest.mark.parametrize("given", ['{"a": 1}', 'text\n```json\n{"a": 1}\n```\nmore', 'Sure: {"a": 1}'])
def test_extract_json(spark, given):
    assert one(spark, lambda c: F.to_json(T.extract_json(c)), given) == '{"a":1}'


def test_extract_json_none(spark):
    assert one(spark, lambda c: T.extract_json(c).isNull(), "nothing") is True


def test_nfkc(spark):
    ship(spark)
    assert one(spark, nfkc, "ﬁ①") == "fi1"


def test_data_urls_have_no_line_breaks(spark):
    import base64

    url = "https://www.example.com/" + "ä" * 200
    made = spark.createDataFrame([(url,)], "u string").select(T.data_url(F.lit("x.PNG"), F.encode("u", "UTF-8"))).first()[0]
    assert made == "data:image/png;base64," + base64.b64encode(url.encode()).decode()
