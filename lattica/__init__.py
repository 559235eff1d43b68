"""lattica: workbook formulas, views, diffs and checks as Spark DataFrame plans."""
