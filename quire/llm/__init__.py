"""Training-data operators: text filtering, de-duplication, scoring, mixing."""
