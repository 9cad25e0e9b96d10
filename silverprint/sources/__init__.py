"""Reading files, images and EXIF records; writing catalog tables."""
