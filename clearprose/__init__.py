"""clearprose: controlled-English lint analytics over text corpora on Spark."""
