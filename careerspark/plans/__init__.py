"""The analysis end to end: play log and people to graded careers, ranking lists to ranks at debut."""
