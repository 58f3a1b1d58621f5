"""Where changes come from and where versions go."""
