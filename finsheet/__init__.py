"""DataFrame operators that turn filing content into checked, analysis-ready tables."""
