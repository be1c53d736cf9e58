"""Set-at-a-time operators over tables."""
