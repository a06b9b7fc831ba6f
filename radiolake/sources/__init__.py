"""Reading and writing the formats of contact logs and of the dumps around them."""
