"""Building blocks that keep plans linear and free of hot tasks."""
