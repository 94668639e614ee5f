"""Short notices side by side in one window are all found."""

from arcweave.llm.license_scan import LicenseScan


def test_every_short_notice_of_a_full_window(spark):
    words = [f"n{i}" for i in range(40)]
    templates = [(f"L{i:02}", " ".join(words[i : i + 5])) for i in range(36)]
    scan = LicenseScan(templates)
    found = scan.scan(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"))
    assert {(r["license"], r["containment"]) for r in found.collect()} == {(name, 1.0) for name, _ in templates}


def test_bands_follow_the_smallest_template():
    short = [("A", "one two three four five")]
    # Alone in its windows a notice needs no more bands; one among 32 shingles needs 218.
    assert LicenseScan(short).class_bands() == {16: 48}
    assert LicenseScan([(str(i), " ".join(f"w{i + j}" for j in range(5))) for i in range(40)]).class_bands() == {16: 218}
    assert LicenseScan().class_bands()[16] > 100
