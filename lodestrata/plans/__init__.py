"""Query plans as data: validation, compilation to DataFrames, binding of question terms."""
