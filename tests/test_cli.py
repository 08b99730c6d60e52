import json

from test_streaming import write_frame_files

from vertebra.cli import main


def test_load_daily_report_end_to_end(spark, tmp, capsys):
    n = write_frame_files(spark, f"{tmp}/in", 0, 40)
    main(["load", "--input", f"{tmp}/in", "--out", f"{tmp}/wh", "--estimator", "recorded"])
    main(["daily", "--out", f"{tmp}/wh"])
    main(["daily", "--out", f"{tmp}/wh", "--day", "2024-01-01"])  # re-run one day: no duplicates
    facts = spark.read.parquet(f"{tmp}/wh/tb_posture")
    mart = spark.read.parquet(f"{tmp}/wh/tb_daily_stat")
    assert facts.count() == n
    assert mart.count() == mart.select("daily_stat_id").distinct().count()
    assert mart.agg({"cnt": "sum"}).first()[0] == facts.filter("posture_status is not null").count()
    capsys.readouterr()
    main(["report", "weekly", "--out", f"{tmp}/wh", "--date", "2024-01-07"])
    score = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert 0 <= score["score"] <= 100
    main(["report", "calendar", "--out", f"{tmp}/wh", "--year", "2024"])
    assert "data_by_month" in capsys.readouterr().out
    main(["report", "weekly-chart", "--out", f"{tmp}/wh", "--date", "2024-01-07"])
    assert len(capsys.readouterr().out.strip().splitlines()) in (4, 8)
    main(["live", "--input", f"{tmp}/in", "--out", f"{tmp}/live", "--checkpoint", f"{tmp}/ck", "--once",
          "--estimator", "recorded"])
    assert spark.read.parquet(f"{tmp}/live/tb_posture").count() == n
