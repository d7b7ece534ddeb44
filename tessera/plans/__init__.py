"""Named query programs, each with its SQL oracle."""
