"""Jobs on DataFrames: trees, diffs, versions, rules, search, quotations, answer logs."""
