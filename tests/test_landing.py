import base64
import json

from lurelight.sources import landing

from .test_operators import cert, u

LOG = {"description": "Log", "operator": "Op", "monitoring_url": "https://m/"}


def drained(spark, stream, name):
    stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_tiles(spark, tmp_path):
    whole = cert("posb-login.top", ["posb-login.top"])
    record = u(1_700_000_000_000, 8) + u(0, 2) + u(len(whole), 3) + whole + u(0, 2) + u(0, 2)
    for part in ("x001/x234/067", "000", "x002/005.p/2", "other"):
        f = tmp_path / "tile" / "data" / part
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(record * 2)
    (tmp_path / "checkpoint").write_text("note")
    want = [0, 1, 2005 * 256, 2005 * 256 + 1, 1234067 * 256, 1234067 * 256 + 1]
    assert sorted(r.cert_index for r in landing.tiles(spark, str(tmp_path), LOG).collect()) == want
    got = drained(spark, landing.tiles(spark, str(tmp_path), LOG, cursor=1, stream=True, files=1), "tiles")
    assert sorted(r.cert_index for r in got.collect()) == want[1:]
    assert got.first().source_ref.startswith("https://m/:") and got.first().log_operator == "Op"


def test_pages(spark, tmp_path):
    whole = cert("posb-login.top", ["posb-login.top"])
    leaf = base64.b64encode(b"\0\0" + u(1_700_000_000_000, 8) + u(0, 2) + u(len(whole), 3) + whole).decode()
    (tmp_path / "1200.json").write_text(json.dumps({"entries": [{"leaf_input": leaf, "extra_data": ""}, {"leaf_input": "AAAA"}, {"leaf_input": leaf}]}))
    (tmp_path / "head.json").write_text("{}")
    for d in (landing.log_pages(spark, str(tmp_path), LOG), drained(spark, landing.log_pages(spark, str(tmp_path), LOG, stream=True), "pages")):
        assert sorted(r.cert_index for r in d.collect()) == [1200, 1202]


def test_messages_and_results(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "s").mkdir()
    (tmp_path / "m" / "a.json").write_text(json.dumps({"message_type": "dns_entries", "data": ["a.com"]}) + "\nnoise\n")
    (tmp_path / "s" / "a.json").write_text(json.dumps({"id": 1, "name_value": "*.b.com"}) + "\n")
    assert [r.dns_names for r in drained(spark, landing.messages(spark, str(tmp_path / "m"), stream=True), "messages").collect()] == [["a.com"]]
    assert [r.dns_names for r in landing.search_results(spark, str(tmp_path / "s")).collect()] == [["b.com"]]
