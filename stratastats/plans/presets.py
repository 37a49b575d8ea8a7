"""Constants of the published analysis.

The operators take all of these as arguments; nothing here is a default that a
caller cannot replace. The renaming of first-level categories to major classes
is not kept here: pass it as ``mapping``.
"""

# All entries below must equal those of the analysis.

YEAR = 2021
PRICE_EQUALS = {"property_type": "All Residential", "region_type": "county"}
PRICE_EXCLUDED_PARENT = "Columbia"
SIGNIFICANT_DIGITS = 6

ATTRIBUTE_EXCLUDED_CODES = ["PR", "DC", "US"]
ID_WIDTH = 5
PARENT_ID_WIDTH = 2

FACT_EXCLUDED_CODES = ["TR", "DM", "PR", "VI", "DC"]
CONTRIBUTORS = {
    "residential": ["Residential", "Light Duty"],
    "commercial": [
        "Comm/Institutional", "Commercial", "Dry Cleaning", "Graphic Arts", "Gas Stations",
    ],
    "industrial": [
        "Industrial", "Bulk", "Agriculture", "Waste", "Degreasing", "Electric Generation",
        "Locomotive", "Aircraft",
    ],
}
EXCLUDED_CLASS = "Fires"
CLASS_ORDER = [
    "Commercial", "Industrial Processes", "Fuel Comb", "Fires",
    "Miscellaneous Non-Industrial NEC", "Mobile",
]

POUNDS_PER_TON = 2000.0

PANEL_METRICS = ["income", "price", "rate", "amount"]
PANEL_DIVISORS = [1e3, 1e5, 1, 1e5]
PANEL_BINS = {"parent": [9, 7, 9, 4], "child": [7, 40, 11, 200]}

INCOME_EDGES = [0, 48000, 57000, 71000, 105000]
INCOME_LABELS = ["<48k", "48k-57k", "57k-71k", "71-105k", ">105k"]

STRATUM_LABELS = {
    1: "Metro Pop. 1MM+",
    2: "Metro 1MM>Pop.>250k",
    3: "Metro 250k>Pop.>20k",
    4: "Urban-Metro- 250k>Pop.>20k",
    5: "Urban not-Metro - 250k>Pop.>20k",
    6: "Urban-Metro- 20k>Pop.>5k",
    7: "Urban not-Metro - 20k>Pop.>5k",
    8: "Rural by Metro - Pop. <2.5k",
    9: "Rural not by Metro - Pop. <2.5k",
}
SHOWN_STRATA = [1, 2, 3, 4, 8]
