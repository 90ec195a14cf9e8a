"""Column functions of the media catalog."""
