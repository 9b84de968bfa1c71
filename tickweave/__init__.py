"""Market analytics as Spark jobs: every operator takes DataFrames or streams and returns them."""
