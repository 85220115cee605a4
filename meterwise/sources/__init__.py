"""Reading, conforming and writing trip, zone and result tables."""
