"""All stages over a small folder, twice."""

from __future__ import annotations

import datetime as dt
import json
import random
from dataclasses import replace

from tidewater.config import Config
from tidewater.operators import extraction
from tidewater.plans import news, runner

CONFIG = replace(Config(), date_end=dt.date(2022, 12, 31), analysis_start=dt.date(2022, 1, 1), min_length=50)


def test_all_stages(spark, tmp_path):
    draw = random.Random(6)
    (tmp_path / "found").mkdir()
    (tmp_path / "inflation").mkdir()
    words = "pasokan panen petani pedagang kenaikan hujan jalan truk gudang kota warga musim pupuk benih waspada kemarin".split()
    rows = []
    for i in range(240):
        text = "harga cabai merah Medan di Karo. " + " ".join(draw.choice(words) + str(draw.randrange(40)) for _ in range(40)) + (" waspada" if i % 3 else " kemarin")
        rows.append({"url": f"https://www.a.example/{i}", "title": f"t{i}", "full_text": text, "published": str(dt.date(2021, 1, 1) + dt.timedelta(i * 3)), "source": "a"})
    rows += [{**rows[0], "url": "https://www.a.example/copy"}, {"url": "https://b.example", "title": "x", "full_text": "", "published": "", "source": "b"}]
    (tmp_path / "found/part.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "inflation/t.csv").write_text("period_id,vf_inflation\n" + "\n".join(f"BW{i:04d},{draw.random():.4f}" for i in range(1, 53)))
    steps = news.stages(spark, str(tmp_path), CONFIG, extraction.Stub(), sample=40)
    done = runner.run(steps)
    assert [d.name for d in done] == list(runner.NAMES)
    assert spark.read.json(str(tmp_path / "rejected")).count() == 1
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 240
    features = spark.read.parquet(str(tmp_path / "features"))
    assert features.count() == 53 and features.agg({"n_articles_total": "sum"}).first()[0] == 240
    assert spark.read.parquet(str(tmp_path / "granger")).count() > 0
    assert spark.read.option("header", True).csv(str(tmp_path / "export")).count() == 53
    assert done[0].result["routed"] == 242 and done[0].result["accepted"] == 241
    sheet = sorted(r["article_id"] for r in spark.read.json(str(tmp_path / "validation/sample")).collect())
    # nothing new is found, so nothing is collected, extracted or drawn again; what was rejected stays so
    again = runner.run(steps, only=["collect", "extract", "validate"])
    assert again[0].result["routed"] == 0
    assert spark.read.json(str(tmp_path / "rejected")).count() == 1
    assert sorted(r["article_id"] for r in spark.read.json(str(tmp_path / "validation/sample")).collect()) == sheet
    assert spark.read.json(str(tmp_path / "articles")).count() == 241
    assert spark.read.json(str(tmp_path / "cache")).count() == 240
