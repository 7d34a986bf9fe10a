"""Fixed values of control-chart practice.

Subgroup sizes 2 to 10; published control-chart constants.
"""

# fixed values: control-chart constants by subgroup size
A2 = {2: 1.880, 3: 1.023, 4: 0.729, 5: 0.577, 6: 0.483, 7: 0.419, 8: 0.373, 9: 0.337, 10: 0.308}
D3 = {2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.076, 7: 0.136, 8: 0.184, 9: 0.223, 10: 0.256}
D4 = {2: 3.267, 3: 2.574, 4: 2.282, 5: 2.114, 6: 2.004, 7: 1.924, 8: 1.864, 9: 1.816, 10: 1.777}
D2 = {2: 1.128, 3: 1.693, 4: 2.059, 5: 2.326, 6: 2.534, 7: 2.704, 8: 2.847, 9: 2.970, 10: 3.078}
C4 = {
    2: 0.797885, 3: 0.886227, 4: 0.921318, 5: 0.939986, 6: 0.951533,
    7: 0.959369, 8: 0.965030, 9: 0.969311, 10: 0.972659,
}
B3 = {2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.030, 7: 0.118, 8: 0.185, 9: 0.239, 10: 0.284}
B4 = {2: 3.267, 3: 2.568, 4: 2.266, 5: 2.089, 6: 1.970, 7: 1.882, 8: 1.815, 9: 1.761, 10: 1.716}

# fixed values: gauge study range divisor by number of repeats; larger studies use the default
GAUGE_D2 = {1: 1.000, 2: 1.128, 3: 1.693, 4: 2.059, 5: 2.326, 6: 2.534}
GAUGE_D2_DEFAULT = 2.326

# fixed values: scale that makes the median absolute deviation estimate a normal sigma
MAD_SCALE = 1.4826

RULES = {
    1: "beyond_3sigma",
    2: "2_of_3_beyond_2sigma",
    3: "4_of_5_beyond_1sigma",
    4: "8_consecutive_same_side",
    5: "6_consecutive_trend",
    6: "15_consecutive_within_1sigma",
    7: "14_consecutive_alternating",
}
