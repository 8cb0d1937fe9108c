import sys

from cuewell.surfaces.cli import main

sys.exit(main())
