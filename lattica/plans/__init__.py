"""From machine-written query graphs to typed, slot-addressed trees."""
