"""Reading dumps and seeds, writing results."""
