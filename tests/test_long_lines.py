from test_lines import H, kinds, outcome

from chronoloom.sources.lines import predictions_loaded


def test_commas_inside_quotes_part_no_columns(spark):
    held = "x," * 30_000
    line = f'f,"{held}",{H},PASS_HIGH'
    assert [r.rttm for r in predictions_loaded(outcome(spark, [("pred", line)]), []).collect()] == [held]
    # stray quotes around as many commas still fail, and do not stop the reader
    assert kinds(spark, "pred", [line, f'f,a"{held}",{H},PASS_HIGH', f'f,"{held},{H},PASS_HIGH', "," * 30_000]) == ["load", "QUOTING", "QUOTING", "COLUMN_COUNT"]
