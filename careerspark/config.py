"""Values of the baseball analysis: milestones, bands, thresholds, dates and levels.

Fixed values: they must be exactly these for the results to be right. The operators take them as arguments.
"""

from __future__ import annotations

# Grades, best first; DNQ = did not qualify.
GRADES = ("Elite", "Great", "Good", "Average", "Below Average", "Poor", "Awful")
GRADE_LEVELS = (*GRADES, "DNQ")
SIMPLE_FIRST_LEVELS = ("Good", "Average", "Bad", "DNQ")
SIMPLE_POST_LEVELS = ("Good", "Average", "Bad")

# Grade score by grade.
GRADE_SCORES = {"Elite": 8, "Great": 7, "Good": 6, "Average": 5, "Below Average": 4, "Poor": 3, "Awful": 2, "DNQ": 1}

# Lower bounds of the bands in thousandths, highest band first; what is below the last bound is the last grade.
BAND_BOUNDS = (400, 370, 340, 320, 310, 291)
HIGHER_IS_BETTER = tuple(zip(BAND_BOUNDS, GRADES[:-1])) + ((None, "Awful"),)
LOWER_IS_BETTER = tuple(zip(BAND_BOUNDS, reversed(GRADES[1:]))) + ((None, "Elite"),)

# Milestones in events.
BATTER_STEP = 150
BATTER_CUTS = (150, 300, 450, 600, 900)
PITCHER_STEP = 215
PITCHER_CUTS = (215, 430, 645, 860, 1290)

# Career totals needed before a grade is given.
BATTER_GATES = {"FIRST_150": 150, "FIRST_600": 600, "POST_150": 600, "POST_600": 1800, "CAREER": 1800}
PITCHER_GATES = {"FIRST_215": 215, "FIRST_860_SP": 860, "POST_215_SP": 860, "POST_215_NON_SP": 430,
                 "POST_860_SP": 2580, "CAREER": 2580}

# Role by ratio of batting to pitching events.
ROLE_LOW, ROLE_HIGH = 0.8, 4.25

# Workload class.
STARTER_PITCHES, RELIEVER_PITCHES, RELIEVER_MEAN_INNING = 70, 40, 5.5

# Dates.
COHORT_AFTER = "1990-04-08"
BIOGRAPHY_FROM = "1990-01-01"
STATUS_CUT = "2020-09-28"
LAST_GAME_FILL = "2020-10-05"
PUBLISH_BEFORE = "2011-01-01"
NEW_PEOPLE_AFTER = "2021-01-01"
LATE_EIGHTIES_AFTER = "1987-01-01"
DEBUT_RATE_TODAY = "2024-01-01"
REFRESH_RANKED_AFTER = "2005-01-01"
REFRESH_DEBUT_AFTER = "2020-01-01"
REFRESH_GAP_NULL_AFTER = "2021-01-01"

# Rankings.
RANK_EDGES = ((1, 25), (26, 50), (51, 75), (76, 100))
RANK_LEVELS = ("1 - 25", "26 - 50", "51 - 75", "76 - 100", "Unranked")
MIN_GAP_WEEKS = -52
MAX_RANK_USES = 31

# Innings that the batters-faced milestones stand for.
CALIBRATION_INNINGS = (50, 200)
