import json

import pytest

from tickloom.operators.serving import registry_violations
from tickloom.sources import registry as r


def feed(**more):
    return {"venue": "V", "category": "c", "code": "x", "kind": "TopOfBook", "group": "g", "emit_trades": True, "arbitration": "Sticky", "publishers": {"explicit": [{"mktdata": 9001, "refdata": 9002}]}} | more


def test_registry(spark, tmp_path):
    def read(document):
        path = tmp_path / f"{abs(hash(str(document)))}.json"
        path.write_text(json.dumps(document))
        return r.read(spark, str(path))

    derived = {"derived": {"ports": {"mktdata": 7000, "refdata": 65530, "snapshot": 8000}, "channels": [{"range": [4, 6], "label": None}, {"id": 5, "label": "five"}]}}
    document = read({"version": 1, "notes": ["n"], "sources": [{"id": 1, "name": "V", "notes": "n"}], "feeds": [feed(), feed(kind="MarketByPrice", publishers=derived, publisher_offset=100, other=1)]})
    assert [tuple(x) for x in r.sources(document).collect()] == [(1, "V")]
    assert sorted((x.kind, x.arbitration, x.mirror_offset) for x in r.feeds(document).collect()) == [("market_by_price", "sticky", 100), ("top_of_book", "sticky", None)]
    got = sorted(((x.channel, x.label, x.mktdata, x.refdata, x.snapshot) for x in r.publishers(document).collect()), key=repr)
    assert got == sorted([(None, None, 9001, 9002, None), (4, None, 7004, 65534, 8004), (5, "five", 7005, 65535, 8005), (6, None, 7006, None, 8006)], key=repr)
    twice = read({"version": 1, "feeds": [feed(), feed(emit_trades=False, arbitration="Coordinated")]})
    broken = {x.rule for x in registry_violations(r.feeds(twice).selectExpr("*", "1 as port")).collect()}
    assert broken == {"duplicate_row", "arbitration_disagrees", "emit_trades_disagrees", "port_used_twice"} and r.sources(twice).collect() == []
    for bad in ({"version": 2, "feeds": [feed()]}, {"version": 1, "feeds": []}, {"version": 1, "feeds": [{"venue": "V"}]}):
        with pytest.raises(ValueError, match="registry"):
            read(bad)
